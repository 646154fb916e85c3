import numpy as np
import pytest

from greenlight.llm import url_filter
from greenlight.llm.queries import URL_RULES

URLS = [
    "http://www.Example.com/en/1", "https://m.example.com/en/2?x=/fr/", "http://example.com/en", "http://EXAMPLE.com/en/#top", "http://a.b.net/es/1", "http://net/fr/",
    "http://xnet/fr/", "http://example.org/en/", "nothing", "", None, "http://", "http://com", "http://com/", "ftp://a.example.com/en/q://r/", "http://a.net?/es/", "http://a..net/es/",
    "http://www.example.com./en/", "http://É.com/es/", "x" * 5000 + "://" + "a." * 2000 + "net/es/" + "p" * 5000,
]


def expected(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, default))
    return host, path, best[1], best[2]


@pytest.mark.parametrize("max_bytes", [1 << 20, 32])  # the second filter is full, so that the join decides alone
def test_rules(spark, max_bytes):
    rules = URL_RULES + [("b.net", "/es/1", "allow"), ("org", "", "block")]
    pages = spark.createDataFrame([(k % 7, u, "clash") for k, u in enumerate(URLS + URLS[:3])], "page_id long, url string, verdict string")
    listed = spark.createDataFrame(rules + [(None, "/", "block"), ("com", None, "block")], "host string, path string, verdict string")
    got = sorted((str(r.page_id), r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, listed, max_bytes=max_bytes).collect())
    assert got == sorted((str(k % 7), *expected(u, rules)) for k, u in enumerate(URLS + URLS[:3]))


def test_filter_has_no_false_negatives(spark):
    keys = np.random.default_rng(2).integers(-(1 << 63), 1 << 63, 3000)
    bloom = url_filter.build_filter(spark.createDataFrame([(int(k),) for k in keys], "hash long"))
    assert url_filter.maybe_contains(bloom, keys).all()
    other = np.random.default_rng(3).integers(-(1 << 63), 1 << 63, 20000)
    assert url_filter.maybe_contains(bloom, other).mean() < 0.01


def test_long_list_without_broadcast_joins_hits_only(spark):
    """With a list too large to broadcast, urls without a possible hit don't come to the join."""
    rules = spark.range(100_000).selectExpr("concat('h', id, '.org') as host", "concat('/', id % 50) as path", "'block' as verdict")
    pages = spark.range(4000).selectExpr("id as page_id", "concat('http://www.h', id * 100, '.org/', if(id % 4 = 0, cast(id * 100 % 50 as string), 'x'), '/p') as url")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        judged = url_filter.judge(pages, rules)
        blocked = judged.where("verdict = 'block'").collect()
        assert {r.page_id for r in blocked} == {k for k in range(1000) if k % 4 == 0} and all(r.rule == f"h{r.page_id * 100}.org/0" for r in blocked)
        assert judged.count() == 4000
        plan = judged._jdf.queryExecution().optimizedPlan().toString()
        union = plan.index("Union")
        assert "Join" not in plan[: union] and plan.count("Join LeftOuter") == 1 and "size(keys" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_empty(spark):
    pages = spark.createDataFrame([(1, "http://a.net/es/")], "page_id long, url string")
    none = spark.createDataFrame([], "host string, path string, verdict string")
    row = url_filter.judge(pages, none, default="block").first()
    assert (row.rule, row.verdict) == (None, "block")
    assert url_filter.judge(pages.limit(0), spark.createDataFrame(URL_RULES, none.schema)).count() == 0

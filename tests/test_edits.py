import os

from pyspark.sql import functions as F

from greenlight.operators import changes, edits, files, versions as ops
from greenlight.session import cut_lineage
from greenlight.sources import store
from tests.conftest import master, versions

EDIT = "version_id string, changed_fields array<string>, new_record_id string"


def moves(spark, *rows):
    return spark.createDataFrame([(v, ["record_id"], to) for v, to in rows], EDIT)


def test_new_record_ids_are_guarded(spark):
    m = master(spark, *({"record_id": k, "decision": d} for k, d in [("P1", "publishing"), ("P2", "not_publishing"), ("P3", "decision_required"), ("P4", "publishing")]))
    v = versions(
        spark, {"version_id": "F1", "record_id": "P1"}, {"version_id": "F2", "record_id": "P2", "excluded": True}, {"version_id": "F3", "record_id": "P3"},
        {"version_id": "F4", "record_id": "X1"}, {"version_id": "F5", "record_id": "X1", "excluded": True}, {"version_id": "F6", "record_id": ""}, {"version_id": "F7", "record_id": "P4"},
    )

    def refusals(*rows):
        return {r["version_id"]: r["refusal"] for r in edits.edit_outcomes(v, m, moves(spark, *rows)).collect()}

    assert refusals(("F1", "P2"), ("F2", "P1"), ("F3", "P1"), ("F6", "P3")) == {"F1": edits.TO_DECIDED, "F2": edits.FROM_DECIDED, "F3": edits.FROM_DECIDED, "F6": edits.TO_DECIDED}
    assert refusals(("F1", "X1"), ("F4", "P1"), ("F6", "X1"), ("F7", "X9")) == {"F1": edits.TO_GROUP, "F4": edits.FROM_GROUP, "F6": edits.TO_GROUP, "F7": ""}
    assert refusals(("F2", " P2 "), ("F1", None), ("F9", "P1"), ("F6", "P4"), ("F7", "P1")) == {"F2": "", "F1": "", "F9": edits.MISSING, "F6": "", "F7": ""}
    assert refusals(("F1", "P4"), ("F1", "P4")) == {"F1": edits.REPEATED} and refusals() == {}


def test_flags_after_edits_equal_a_full_recompute(spark):
    m = master(spark, *({"record_id": f"P{k}", "decision": "publishing"} for k in range(6)))
    v = cut_lineage(ops.recompute(versions(spark, *({"version_id": f"F{k}", "record_id": f"P{k % 5}", "discarded": k % 7 == 6} for k in range(40)))))
    asked = moves(spark, ("F38", "P0"), ("F39", "P5"), ("F10", ""), ("F37", None))
    out = cut_lineage(edits.edit_versions(v, m, asked, cut_lineage(edits.edit_outcomes(v, m, asked))))
    assert out.columns == v.columns and out.count() == 40
    columns = ["version_id", "record_id", "active", "replaced"]
    assert out.select(columns).exceptAll(ops.recompute(out).select(columns)).count() == 0
    got = {r["version_id"]: r for r in out.collect()}
    assert got["F38"]["active"] and not got["F35"]["active"] and got["F39"]["active"] and got["F33"]["active"]
    assert got["F10"]["record_id"] == "" and not got["F10"]["active"] and not got["F10"]["replaced"]
    assert ops.recompute_touched(v, v.limit(0)).exceptAll(v).count() == 0


def test_only_touched_records_are_judged_again(spark, tmp_path):
    ops.recompute(versions(spark, *({"version_id": f"F{k}", "record_id": f"P{k}"} for k in range(9)))).write.parquet(str(tmp_path / "v"))
    v = spark.read.parquet(str(tmp_path / "v"))
    plan = ops.recompute_touched(v, v.filter("version_id = 'F3'"))._jdf.queryExecution().optimizedPlan().toString()
    winners = plan[plan.index("max(") :]
    assert "LeftSemi" in winners and plan.count("max(") == 1


def test_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.range(200).select(F.concat(F.lit("k"), "id").alias("key"), F.col("id").alias("n"), F.lit("old").alias("text"))
    store.write_store(rows, path, ["key"], 16)

    def held():
        return {os.path.join(at, n): os.stat(os.path.join(at, n)).st_mtime_ns for at, _, names in os.walk(path) for n in names if n.startswith("part-")}

    before = held()
    new = spark.createDataFrame([("k5", "new"), ("fresh", None)], "key string, text string")
    touched = store.upsert_store(spark, path, new, ["key"])
    after = held()
    kept = {f for f in before if int(f.split("store_bucket=")[1].split("/")[0]) not in touched}
    assert 1 <= len(touched) <= 2 and len(kept) >= 14
    assert all(after[f] == before[f] for f in kept) and set(after) & set(before) == kept
    spark.catalog.refreshByPath(path)
    want = changes.upsert(rows, new, ["key"])
    got = store.read_store(spark, path)
    assert got.columns == ["key", "n", "text"] and got.count() == 201 and got.exceptAll(want).count() == 0
    assert store.upsert_store(spark, path, new.limit(0), ["key"]) == [] and held() == after


def test_largest_files(spark):
    rows = spark.createDataFrame([(f"f{k}", k // 2) for k in range(9)], "path string, length long")
    assert [r["path"] for r in files.largest(rows, 3).collect()] == ["f8", "f6", "f7"]
    assert files.largest(rows.limit(0)).count() == 0


def test_touched_records_need_no_second_look_at_the_table_by_version(spark):
    """With the former ids at hand, untouched records meet record ids only; blank and missing ids take part."""
    rows = [("F1", "P1"), ("F2", "P1"), ("F3", "P2"), ("F4", ""), ("F5", None), ("F6", "P3"), ("F7", None)]
    v = ops.recompute(versions(spark, *({"version_id": i, "record_id": r} for i, r in rows)))
    to = {"F2": "P2", "F4": "P3", "F5": "P1"}
    old = v.filter(F.col("version_id").isin(*to))
    new = F.create_map(*[F.lit(x) for pair in to.items() for x in pair])[F.col("version_id")]
    changed = old.withColumn("record_id", new)
    want = sorted((r["version_id"], r["record_id"], r["active"], r["replaced"]) for r in ops.recompute(v.filter(~F.col("version_id").isin(*to)).unionByName(changed)).collect() if r["record_id"])
    for was in (None, old.select("record_id")):
        out = ops.recompute_touched(v, changed, was=was).collect()
        assert len(out) == len(rows) and sorted((r["version_id"], r["record_id"], r["active"], r["replaced"]) for r in out if r["record_id"]) == want

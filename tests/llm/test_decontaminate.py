from greenlight.llm import decontaminate

ITEMS = [
    (1, "Alice has 12 apples and gives 5 kg of them to Bob before Alice walks the long road home to her mother."),
    (2, "Which planet of the solar system has the largest number of known moons around it today?"),
    (3, "tiny item here"),
    (4, None),
    (5, "7 8 9"),
]
PAD = "Completely other words stand here in this clean sentence about the weather and about nothing else at all. "


def found(spark, docs, items=ITEMS, **parameters):
    d = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    rows = decontaminate.leaks(d, b, **parameters).collect()
    assert all(0 < r.matched <= r.windows for r in rows)
    return sorted((str(r.doc_id), r.item_id) for r in rows)


def test_finds_copies_and_new_parameters(spark):
    docs = [
        (10, PAD + ITEMS[0][1] + " " + PAD),
        (11, PAD + ITEMS[0][1].upper()),
        (12, PAD + ITEMS[1][1].lower().replace("?", "") + PAD),
        (13, "Carla has 900 apples and gives 3.5 lb of them to Dora before Carla walks the long road home to her mother."),  # new names, numbers, unit
        (14, "Carla has 900 apples and gives 3 kg of them to Dora before Emil walks the long road home to her mother."),  # slots that don't agree
        (15, PAD),
        (16, "a tiny item here and nothing else"),
        (17, "7 8 9 and 7 8 9"),
        (18, "Which planet of the solar system has rings? " + PAD),  # too little of it
        (19, None),
        (20, ""),
        (None, ITEMS[1][1]),
        (21, ITEMS[1][1]),
        (21, ITEMS[1][1]),
        (22, (PAD * 3000) + ITEMS[1][1]),
    ]
    assert found(spark, docs, cover=0.6) == sorted([("10", 1), ("11", 1), ("12", 2), ("13", 1), ("16", 3), ("None", 2), ("21", 2), ("22", 2)])


def test_filter_keeps_clean_rows(spark):
    docs = spark.createDataFrame([(1, ITEMS[1][1], "x"), (1, PAD, "y"), (2, PAD, None), (None, ITEMS[1][1], "z"), (None, None, "w")], "doc_id long, text string, source string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = decontaminate.decontaminate(docs, items)
    assert kept.columns == docs.columns
    assert sorted(str(r.source) for r in kept.collect()) == ["None", "w", "y"]


def test_one_number_replaced_in_two_ways(spark):
    words = [f"{a}{b}" for a in ("alpha", "beta", "gamma", "delta", "kappa") for b in "abcdefghij"]
    words[10] = words[14] = "12"
    copy = list(words)
    copy[14] = "13"
    assert found(spark, [(1, " ".join(copy)), (2, PAD)], [(1, " ".join(words))]) == [("1", 1)]


def test_items_without_template_windows(spark):
    items = [
        (1, "Compute 12 * 7 + 3 * 5 - 8 * 2 + 9"), (2, "山路を登りながらこう考えた。智に働けば角が立つ"), (3, "สวัสดีชาวโลกทั้งหลาย"), (4, "7 8 9"), (5, "5 kg"),
    ]
    docs = [(k, f"{PAD} {t} {PAD}") for k, t in items] + [(6, "Compute 12 * 7 + 4 * 6 - 8 * 3 + 9"), (7, "山が高い。川が長い")]
    assert found(spark, docs, items) == [("1", 1), ("2", 2), ("3", 3)]
    b = spark.createDataFrame(items, "item_id long, text string")
    assert sorted(r.item_id for r in decontaminate.without_windows(b).collect()) == [4, 5]


def test_a_long_run_is_a_leak_of_any_item(spark):
    words = [f"{a}{b}" for a in ("alpha", "beta", "gamma", "delta", "kappa", "sigma", "omega", "theta") for b in "abcdefghij"]
    words[31:36] = "12 7 3 5 kg".split()
    cut = lambda a, b: f"{PAD} {' '.join(words[a:b])} {PAD}"
    docs = [(1, cut(0, 80)), (2, cut(27, 40)), (3, cut(27, 39)), (4, cut(60, 73)), (5, cut(0, 8) + cut(20, 28) + cut(50, 58)), (6, PAD)]
    assert found(spark, docs, [(1, " ".join(words))]) == [("1", 1), ("2", 1), ("4", 1)]


def test_empty(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, PAD)], []) == []

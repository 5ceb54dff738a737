"""Work that has to grow no faster than the input: what the plans exchange, and how often they read."""

import unicodedata

from pyspark.sql import functions as F

from billmill.functions import money, text
from billmill.operators import checks, grid, learning, pages, skew
from billmill.plans import checking
from billmill.sources import bindings, landing


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def bill_cells(spark):
    rows = [("f", 0, 0, "Item"), ("f", 0, 1, "Amount"), ("f", 1, 0, "Tea"), ("f", 1, 1, "4.50"), ("f", 2, 0, " \u00a0\t")]
    cells = spark.createDataFrame(rows, "file_id string, row int, col int, value string")
    return cells.select("file_id", F.lit("Bill").alias("sheet"), "row", "col", "value", F.lit(False).alias("is_number"))


def test_sheets_of_one_name_are_exchanged_once(spark):
    items = grid.find_items(grid.read_cells(bill_cells(spark)))
    assert plan_of(items).count("Exchange hashpartitioning") == 1
    assert [(r.header_row, r.last_row, r.line_items[0].description) for r in items.collect()] == [(0, 1, "Tea")]
    assert plan_of(grid.read_receipts(bill_cells(spark))).count("Exchange hashpartitioning") == 1


def test_blank_cells_are_told_as_clean_text_tells_them(spark):
    values = ["", " ", "a", " a ", "\t\u00a0\u2003", "\u200b", "\x1c", "₹", None, "\u3000x"]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select(
        F.coalesce(text.has_text(F.col("v")), F.lit(False)).alias("has"), text.clean_text(F.col("v")).isNotNull().alias("kept"))
    assert all(r.has == r.kept for r in rows.collect())


def test_cells_as_lines(spark):
    cells = "array(struct(0 AS row, 'a' AS value), struct(0 AS row, 'b' AS value), struct(2 AS row, '' AS value), struct(2 AS row, 'c' AS value), struct(3 AS row, 'd' AS value))"
    row = spark.range(1).select(F.expr(cells).alias("c")).select(text.lines_of_cells(F.col("c")).alias("t")).first()
    assert row.t == "a b\n c\nd"


def test_filters_on_receipts_read_nothing_again(spark):
    lines = spark.createDataFrame(
        [("f", 1, 0, "Bill No: B-7"), ("f", 1, 1, "Date: 3 May 2001"), ("f", 1, 2, "Total Rs. (1,23,456.50)")],
        "file_id string, page int, line_no int, text string")
    read = pages.read_receipts(lines)
    filters = [line for line in plan_of(read).splitlines() if "Filter " in line]
    assert filters and not any("regexp_extract" in line.lower() or "strongest" in line for line in filters)
    found = read.first()
    assert (found.receipt_number, str(found.receipt_date), str(found.total)) == ("B-7", "2001-05-03", "-123456.50")


def test_amounts_of_digits_and_commas_read_as_before(spark):
    printed = {"1,23,456.50": "123456.50", "1,,2": "12.00", "-5": "-5.00", "--5": "5.00", "5\n": "5.00", "5.": None, "(5)": "-5.00",
               "9,.5": "9.50", "\u0663": None, "12.345": "12.35", "": None, "99999999999": None}
    rows = spark.createDataFrame([(v,) for v in printed], "v string").select("v", money.parse_amount(F.col("v")).alias("a"))
    assert {r.v: None if r.a is None else str(r.a) for r in rows.collect()} == printed


def test_parts_follow_the_size_of_the_texts(spark):
    files = spark.createDataFrame([(str(i), "a,b\n" * 50) for i in range(40)], "file_id string, text string")
    held = skew.spread(files, "file_id", F.length("text"), part_size=200)
    assert held.rdd.getNumPartitions() == -(-40 * (200 + skew.ROW_SIZE) // 200)
    assert skew.spread(files.limit(0), "file_id", F.length("text")).rdd.getNumPartitions() >= 1


def test_sheets_are_trimmed_and_written_without_reading_twice(spark):
    files = spark.createDataFrame([("f", "a,b,,\n\n1,\"x\"\"y\",,\n,,,\n")], "file_id string, text string")
    trimmed = landing.trim_cells(landing.csv_cells(files))
    assert "Join" not in plan_of(trimmed)
    assert sorted((r.row, r.col, r.value) for r in trimmed.filter("value IS NOT NULL").collect()) == [(0, 0, "a"), (0, 1, "b"), (2, 0, "1"), (2, 1, 'x"y')]
    texts = landing.sheet_texts(bill_cells(spark).withColumn("sheet", F.col("file_id")))
    assert plan_of(texts).count("Exchange hashpartitioning") == 1
    assert [r.text for r in texts.collect()] == ["Item Amount\nTea 4.50\n \u00a0\t"]


def test_learned_labels_read_texts_once(spark):
    receipts = spark.createDataFrame(
        [(1, "Shop", "to settle 4.50"), (2, "Other", "levy 2.00\nto settle 9.00"), (3, None, "levy 3.00"), (4, "Shop", "levy -")],
        "id long, vendor string, text string").withColumns({f: F.lit(None).cast("decimal(12,2)") for f in ("subtotal", "tax", "total")})
    vendors = spark.createDataFrame([(1, "Shop", "Shop"), (2, "Other", "Other")], "id long, raw_name string, normalized_name string")
    known = spark.createDataFrame(
        [("shop", "total", "to settle")] + [(v, "tax", "levy") for v in ("a", "b", "c")], "vendor_key string, field string, label string")
    found = learning.matches(receipts, known, vendors)
    assert plan_of(found).count("Generate posexplode") == 2
    got = sorted((r.id, r.field, r.label, str(r.amount)) for r in found.collect())
    assert got == [(1, "total", "to settle", "4.50"), (2, "tax", "levy", "2.00"), (3, "tax", "levy", "3.00")]


def test_composed_text_below_300_is_not_sent_to_python(spark, monkeypatch):
    edges = "".join(chr(c) for c in range(0x110000) if chr(c).isspace())
    assert sorted(edges) == sorted(text.EDGE_SPACES)
    values = [edges + "a b" + edges, "e\u0301t\u00e9 ", "\u00e9\u02ff\x85", "\uac00\u11a8", "\U0001d15e ", "", None, "\u2000"]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select(text.composed(F.col("v")).alias("c")).collect()
    assert [r.c for r in rows] == [None if v is None else unicodedata.normalize("NFC", v).strip() for v in values]
    monkeypatch.setattr(text, "_nfc", lambda names: names.map(lambda name: None if name is None else "sent"))
    sent = spark.createDataFrame([("caf\u00e9",), ("cafe\u0301",)], "v string").select(text.composed(F.col("v")).alias("c")).collect()
    assert [r.c for r in sent] == ["caf\u00e9", "sent"]


def test_checked_receipts_are_worked_out_once(spark, sf_dir):
    found = checking.all_problems(spark, sf_dir)
    assert found.inputFiles() and not any(sf_dir in path for path in found.inputFiles())
    assert "Join" not in plan_of(checks.arithmetic_problems(checking.named_receipts(spark, sf_dir)))
    assert "Join" not in plan_of(checks.date_problems(checking.named_receipts(spark, sf_dir), today=bindings.today()))


def test_words_are_folded_once_and_grouped_once(spark):
    """Words of a page meet in one aggregate; their lines are stretches of them. Against the rule
    taken word by word, over uneven boxes of different heights, ties and boxes without a text."""
    import random

    from billmill.operators import words

    source, rows = random.Random(7), []
    for page in range(1, 13):
        for _ in range(source.randrange(1, 90)):
            top = source.randrange(0, 400) / source.choice([1, 2, 3])
            height = source.choice([0, 8, 20, 21, 60, -3])
            rows.append((f"f{page % 3}", page, source.choice(["a", "b", "Total1", "x\ny", None]), float(source.randrange(6) * 50), top, top + height))
    boxes = spark.createDataFrame(rows, "file_id string, page int, text string, left double, top double, bottom double")
    boxes = boxes.filter("text IS NOT NULL OR left < 200")

    def beside(a, b):
        height = lambda w: max(w[5] - w[4], 1.0)
        apart = abs((a[4] + a[5]) - (b[4] + b[5])) / 2
        return apart <= max(a[5] - a[4], b[5] - b[4]) / 2 - min(height(a), height(b)) * words.EDGE

    expected = {}
    for key in {(r[0], r[1]) for r in rows}:
        own = [r for r in rows if (r[0], r[1]) == key and (r[2] is not None or r[3] < 200)]
        own.sort(key=lambda w: ((w[4] + w[5]) / 2, w[3], w[4], w[5], w[2] is not None, w[2] or ""))
        firsts, lines = [], []
        for at, w in enumerate(own):
            joined = [n for n in reversed(range(max(0, len(firsts) - words.LINES_LOOKED_AT), len(firsts))) if beside(firsts[n], w)]
            if not joined:
                firsts.append(w)
                lines.append([])
            lines[joined[0] if joined else -1].append((w[3], at, w[2]))
        for n, line in enumerate(lines):
            expected[(*key, n)] = " ".join(t for _, _, t in sorted(line, key=lambda w: w[:2]) if t is not None)
    found = words.words_to_lines(boxes)
    got = {(r.file_id, r.page, r.line_no): r.text.replace("Total 1", "Total1") for r in found.collect()}
    assert got == expected
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1, plan


def test_dates_are_searched_for_only_where_they_can_be(spark):
    """A text without a date's label or a month's name is not searched for dates after or with it;
    what is found stays the same, for letters too that only Unicode takes for others."""
    from billmill.functions import dates
    from billmill.operators import pages

    texts = ["DATE: 3 Mar 2024", "Dated 03/04/2024", "İnvoice Date 1-1-2024", "5 ſep 2023", "ſep 4, 2023", "Bill\tDate 2024-02-03 Txn  date 1.2.2024",
             "no day here 12 34", "12 mai 2024", "7th of Oct 2024 8 Oct 2024", "x\u00017 JUN 24", "update 2024-05-06", "", None, "₹ 5 dated 9 nov 2022"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    found = rows.select("id", pages.date_text(F.col("text")).alias("at")).select("id", "at", dates.find_date(F.col("at")).alias("day"))
    days = {r.id: None if r.day is None else str(r.day) for r in found.collect()}
    assert days == {0: "2024-03-03", 1: "2024-04-03", 2: "2024-01-01", 3: None, 4: None, 5: "2024-02-03", 6: None, 7: None,
                    8: "2024-10-08", 9: "2024-06-07", 10: "2024-05-06", 11: None, 12: None, 13: "2022-11-09"}
    plan = found._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("contains(lower(text") >= len(pages._DATE_PATTERNS) and dates.MONTH_SEEN.replace("(?iU)", "(?i)").lower() in plan


def test_cells_that_are_no_labels_carry_no_neighbours(spark):
    """The windows over a sheet copy what a cell holds, so only labels hold what stands beside them."""
    near = grid.with_neighbours(grid.read_cells(bill_cells(spark).unionByName(
        spark.createDataFrame([("f", "Bill", 3, 0, "Total", False), ("f", "Bill", 3, 1, "Tax", False), ("f", "Bill", 4, 0, "4.50", True), ("f", "Bill", 4, 1, "0.50", True)],
                              "file_id string, sheet string, row int, col int, value string, is_number boolean"))))
    rows = {(r.row, r.col): (r.label and r.label.label, r.beside and (r.beside.text, r.beside.is_number)) for r in near.collect()}
    assert rows == {(0, 0): (None, None), (0, 1): (None, None), (1, 0): (None, None), (1, 1): (None, None), (3, 0): ("total", ("4.50", True)),
                    (3, 1): ("tax", ("0.50", True)), (4, 0): (None, None), (4, 1): (None, None)}


def test_what_is_left_of_every_label(spark):
    """The label found by halves is the one of the whole list, with what rest_after leaves of it."""
    from billmill.functions import labels
    from billmill.model import LABELS

    after = ["", " ", ":- x\ny", " (", "\t12.50|", " ſ é", "s", " .İ₹ 5 "]
    texts = [before + shown + tail for x in LABELS for shown in (x.text, x.text.upper().replace(" ", " . ")) for before in ("", "#(") for tail in after]
    rows = spark.createDataFrame([(t,) for t in [*texts, "", "no label", "totals", None]], "text string")
    found = rows.select("text", labels.match_label(F.col("text")).alias("m")).withColumn(
        "rest", labels.rest_after(F.col("text"), labels.value_pattern_column(F.col("m.label")))
    )
    known = {x.text: x for x in LABELS}
    held = [r for r in found.collect() if r.m]
    assert {x.text for x in LABELS if "#" not in x.text and not x.text.endswith(" no")} <= {r.m.label for r in held} <= set(known)
    assert all((r.m.field, r.m.priority) == (known[r.m.label].field, known[r.m.label].rank) and r.m.rest == r.rest for r in held)

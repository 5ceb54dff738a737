"""Operators on small tables made for them, against brute force where that says it best."""

import datetime as dt
import io
import random
import zipfile
from collections import defaultdict
from decimal import Decimal as D

import pandas as pd
import pytest
from pyspark.sql import functions as F

from billmill.functions import sqlnames, text
from billmill.operators import categories, checks, compare, learning, search, skew
from billmill.operators import files as file_ops
from billmill.plans.catalog import QUERIES
from billmill.sources import bindings, landing, sinks
from billmill.streaming import jobs


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- hot keys ---------------------------------------------------------------------------------


def test_numbering_hot_keys_gives_the_same_positions(spark):
    random.seed(5)
    rows = [("hot" if i % 3 == 0 else f"k{i % 40}", random.random(), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, v double, id bigint").repartition(7)
    plain = skew.numbered(df, ["k"], ["v", "id"], "n")
    spread = skew.numbered(df, ["k"], ["v", "id"], "n", heavy_rows=100)
    assert "CheckpointRDD" in spread._jdf.queryExecution().toString() or spread.count() == 3000
    key = lambda r: (r.k, r.v, r.id)
    assert {key(r): r.n for r in spread.collect()} == {key(r): r.n for r in plain.collect()}


def test_first_per_key_limits_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    top = skew.first_per_key(df, ["k"], [F.col("id").desc()], how_many=2)
    assert plan_of(top).count("WindowGroupLimit") == 2  # one of them below the exchange
    assert sorted(r.id for r in top.collect()) == [994, 995, 996, 997, 998, 999]


def test_admitted_batches_use_up_the_cap(spark):
    asked = [(1, n, f, at) for n, size, at in ((7, 4, 2), (3, 4, 1), (5, 1, 3)) for f in range(size)]
    requests = spark.createDataFrame(asked, "day int, batch_id bigint, file_id int, at int")
    used = spark.createDataFrame([(1, 1)], "day int, used bigint")
    got = {r.batch_id: (r.asked, r.remaining, r.admitted) for r in compare.admit_batches(requests, used, 6).collect()}
    assert got == {3: (4, 5, True), 7: (4, 1, False), 5: (1, 1, True)}


def test_two_renames_to_one_name(spark):
    schema = "id bigint, builtin boolean, receipts_using bigint, vendors_using bigint, name string"
    known = spark.createDataFrame([(i, False, 0, 0, f"c{i}") for i in (1, 2, 3)], schema)
    asked = spark.createDataFrame([(1, "rename", "Same", 2), (2, "rename", "same", 1), (3, "rename", "New", 3)],
                                  "id bigint, action string, name string, at int")
    got = {r.id: r.refused for r in categories.change(known, known, asked).collect()}
    assert got == {1: 'A category called "Same" already exists.', 2: None, 3: None}


def test_duplicates_with_one_key_in_a_third_of_the_rows(spark):
    random.seed(3)
    rows = []
    for i in range(400):
        vendor = "Acme" if i % 3 == 0 else f"V{random.randrange(4)}"
        number = "1" if i % 3 == 0 else random.choice(["7", "8", None])
        rows.append((i, random.randrange(60), 1, vendor, vendor.upper() if i % 2 else vendor, number,
                     dt.date(2026, 1, 1 + i % 3), D("5.00"), random.choice(["parsed", "rejected"]),
                     f"R{i}"))
    df = spark.createDataFrame(
        rows, "id bigint, file_id bigint, seq int, normalized_name string, vendor string, "
              "receipt_number string, receipt_date date, total decimal(12,2), status string, "
              "ref_no string")  # fmt: skip
    for symmetric in (False, True):
        got = {r.id: r.other.ref_no for r in checks.duplicates(df, df, symmetric=symmetric).collect()}
        want = {}
        for a in rows:
            others = [
                b[0] for b in rows
                if b[3].lower() == a[4].lower() and b[7] == a[7] and b[1] != a[1] and b[8] == "parsed"
                and (b[5] == a[5] if a[5] else b[6] == a[6])
            ]
            first = min(others, default=None)
            if first is not None and (symmetric or first < a[0]):
                want[a[0]] = f"R{first}"
        assert got == want


# --- searches ----------------------------------------------------------------------------------


SEED = [
    ("Ring Road Petrol Pump", "2026-08-02", "2100.00", "Fuel"),
    ("Ring Road Petrol Pump", "2026-08-14", "1850.00", "Fuel"),
    ("Sector 12 Fuel Station", "2026-08-20", "2400.00", "Fuel"),
    ("Sector 12 Fuel Station", "2026-09-01", "900.00", "Fuel"),
    ("Raju Hardware", "2026-08-05", "500.00", None),
]


@pytest.fixture(scope="module")
def view(spark):
    rows = [(i, f"R{i}", f"F{i}", "parsed", dt.date.fromisoformat(d), v, None, 1 if c else None, c,
             None, None, D(t)) for i, (v, d, t, c) in enumerate(SEED)]
    rows.append((9, "R9", "F9", "flagged", dt.date(2026, 8, 9), "X", None, 1, "Fuel", None, None, D("7")))
    return spark.createDataFrame(
        rows, "id int, ref_no string, file_ref_no string, status string, receipt_date date, vendor string, "
              "receipt_number string, category_id int, category string, subtotal decimal(12,2), "
              "tax decimal(12,2), total decimal(12,2)")  # fmt: skip


def test_fuel_in_august(view):
    query = search.ReceiptQuery(
        date_from=dt.date(2026, 8, 1), date_to=dt.date(2026, 8, 31), category_id=1
    )
    got = search.totals(search.limited(view, query)).first()
    assert (got.receipts, got.sum_total, got.average_total) == (3, D("6350.00"), D("2116.67"))
    top = search.ReceiptQuery(sort="amount", limit=2)
    assert search.totals(search.limited(view, top)).first().sum_total == D("4500.00")
    assert [r.total for r in search.page(view, top).collect()] == [D("2400.00"), D("2100.00")]
    assert search.page(view, search.ReceiptQuery(page=5)).count() == 0


@pytest.mark.parametrize(
    ("filters", "message"),
    [
        ({"date_from": dt.date(2026, 9, 1), "date_to": dt.date(2026, 8, 1)}, "From cannot be later"),
        ({"min_total": D(10), "max_total": D(5)}, "minimum amount"),
        ({"min_total": D(-1)}, "negative"),
        ({"limit": 501}, "limit"),
        ({"page": 0}, "Pages"),
        ({"sort": "vendor"}, "Sort"),
        ({"colour": "red"}, "Unknown filter"),
    ],
)
def test_bad_filters_are_refused(filters, message):
    with pytest.raises(search.BadQuery, match=message):
        search.ReceiptQuery.of(**filters)


def test_default_dates():
    q = search.with_default_dates(search.ReceiptQuery(), dt.date(2027, 2, 10))
    assert (q.date_from, q.date_to) == (dt.date(2026, 4, 1), dt.date(2027, 2, 10))
    only_to = search.with_default_dates(search.ReceiptQuery(date_to=dt.date(2026, 5, 1)), dt.date(2026, 9, 1))
    assert only_to.date_from is None


def test_vendor_text_stays_a_literal(view):
    query = search.ReceiptQuery(vendor="O'Brien'; DROP TABLE files; --")
    assert search.matching(view, query).count() == 0


@pytest.mark.parametrize("sort", ["date", "amount"])
def test_pages_by_the_last_row_are_the_numbered_pages(spark, sort, monkeypatch):
    monkeypatch.setattr(search, "PAGE_SIZE", 3)
    days = [None, dt.date(2001, 5, 1), dt.date(2001, 5, 2)]
    totals = [D(0), D(100), None, D(100), D(5)]
    rows = [(f"R-{i:02}", days[i % 3], totals[i % 5], "parsed") for i in range(17)]
    made = spark.createDataFrame(rows, "ref_no string, receipt_date date, total decimal(12,2), status string")
    made = made.withColumns({c: F.lit(None).cast("string") for c in search.ROW_COLUMNS if c not in made.columns}).cache()
    for limit in (None, 10):
        found, last, page = [], None, 1
        while True:
            q = search.ReceiptQuery(sort=sort, limit=limit, page=page)
            wanted = search.page(made, q).collect()
            got = wanted if last is None else search.page_after(made, q, last, shown=len(found)).collect()
            assert got == wanted
            if not got:
                break
            found += got
            end = got[-1]
            last = (*([end.total] if sort == "amount" else []), end.receipt_date, end.ref_no)
            page += 1
        assert len(found) == (limit or 17)


def test_csv_export(view, tmp_path):
    path = str(tmp_path / "export")
    sinks.export_csv(view, search.ReceiptQuery(category_id=1, sort="amount"), path)
    text = "".join(p.read_text(encoding="utf-8") for p in sorted((tmp_path / "export").glob("part-*")))
    lines = text.splitlines()
    assert lines[0].startswith("﻿Date,Vendor,Receipt no.,Category,Subtotal,Tax,Total,Reference,File")
    assert lines[1].startswith("2026-08-20,Sector 12 Fuel Station,") and len(lines) == 5


def test_view_by_financial_year_prunes_folders(spark, view, tmp_path):
    path = str(tmp_path / "view")
    sinks.write_view(view, path)
    read = spark.read.parquet(path).filter("fy = 2026 AND total > 1000")
    plan = plan_of(read)
    assert "PartitionFilters: [isnotnull(fy" in plan and "GreaterThan(total,1000" in plan
    assert read.count() == 3


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    flags = bindings.flags(spark, sf_dir).filter("type = 'duplicate_receipt'").select("id")
    assert "ReadSchema: struct<o_orderkey:bigint>" in plan_of(flags)


# --- files -----------------------------------------------------------------------------------------


def test_recovery_boundaries(spark):
    now = dt.datetime(2026, 9, 1, 12, 0, 0)
    cases = [("pending", 0, 29, False, False), ("pending", 0, 31, True, False),
             ("failed", 1, 59, False, False), ("failed", 1, 61, True, False),
             ("failed", 2, 119, False, False), ("failed", 2, 121, True, False),
             ("failed", 3, 9999, False, False), ("processing", 1, 599, False, False),
             ("processing", 1, 601, False, True)]
    rows = [(i, s, a, now - dt.timedelta(seconds=age)) for i, (s, a, age, _, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, "id int, status string, attempts int, status_changed_at timestamp_ntz")
    df = df.withColumn("status_changed_at", F.col("status_changed_at").cast("timestamp"))
    at = F.lit("2026-09-01 12:00:00").cast("timestamp")
    assert {r.id for r in file_ops.due(df, at).collect()} == {i for i, c in enumerate(cases) if c[3]}
    reset = {r.id for r in file_ops.reset_stuck(df, at).filter("status = 'pending' AND attempts = 1").collect()}
    assert reset == {i for i, c in enumerate(cases) if c[4]}


def zipped(*names, text="x", comment=b""):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as archive:
        for name in names:
            archive.writestr(name, text)
        archive.comment = comment
    return held.getvalue()


def test_archives_by_their_directory(spark):
    many = [f"sheets/{i}.xml" for i in range(300)]
    book = zipped(*many, "xl/workbook.xml")
    broken = bytearray(book)
    broken[broken.rindex(b"PK\x01\x02")] = 0
    cases = [
        (book, "workbook"), (zipped("xl/workbook.xml", comment=b"by PK\x05 hand" * 2000), "workbook"),
        (b"#!before" + book, "workbook"), (zipped(*many, text="xl/workbook.xml"), "archive"),
        (zipped("old/xl/workbook.xml", "xl/workbook.xml.bak"), "archive"), (zipped(), "archive"),
        (book[:-30], "damaged"), (book[: len(book) // 2], "damaged"), (bytes(broken), "damaged"),
        (b"PK\x03\x04 xl/workbook.xml", "damaged"), (b"PK\x05\x06", "damaged"), (book + b"\x00" * 9, "workbook"),
    ]
    rows = spark.createDataFrame([(i, bytearray(c)) for i, (c, _) in enumerate(cases)], "id int, content binary")
    got = {r.id: r.k for r in rows.select("id", landing.archive_kind(F.col("content")).alias("k")).collect()}
    assert got == {i: k for i, (_, k) in enumerate(cases)}


def test_landing_kinds_and_refusals(spark, tmp_path):
    files = {
        "a.bin": b"%PDF-1.4 x", "b.bin": zipped("xl/workbook.xml"), "c.bin": zipped("other"), "n.bin": b"PK\x03\x04...xl/workbook.xml...",
        "d.bin": b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "e.bin": b"\xff\xd8\xff\xe0", "f.bin": b"\x89PNG\r\n\x1a\n",
        "g.bin": b"RIFF0000WEBP", "h.bin": b"0000ftypheic", "i.bin": b"a,b\nc,d\n", "j.bin": b"just words",
        "l.bin": b"x" * 500, "m.bin": b"a\x00,b\nc,d\n",
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    kept, refused = landing.read_landing(spark, str(tmp_path), max_bytes=400)
    assert [r.path[-5:] for r in refused.collect()] == ["l.bin"]
    got = {r.path[-5:]: (r.k.kind, r.k.problem) for r in
           kept.select("path", landing.detect(F.col("content")).alias("k")).collect()}
    assert {n: k for n, (k, _) in got.items()} == {
        "a.bin": "pdf", "b.bin": "excel", "c.bin": None, "d.bin": "excel", "e.bin": "image", "f.bin": "image",
        "g.bin": "image", "h.bin": "image", "i.bin": "csv", "j.bin": None, "m.bin": None, "n.bin": None,
    }
    assert "zip archive" in got["c.bin"][1] and "damaged" in got["n.bin"][1]
    # The scan leaves empty files out; as rows they are told apart.
    empty = spark.createDataFrame([(bytearray(),)], "content binary")
    assert empty.select(landing.detect(F.col("content"))["problem"]).first()[0] == "The file is empty."


# --- learning ----------------------------------------------------------------------------------------


def test_a_label_is_learned_once_and_shared_after_three_vendors(spark):
    vendors = spark.createDataFrame([(1, "A", "A")], "id int, raw_name string, normalized_name string")
    money = "subtotal decimal(12,2), tax decimal(12,2), total decimal(12,2)"
    texts = spark.createDataFrame(
        [(1, "Shop A\nBill Value: Rs 500.00"), (2, "Pay 7.00\nOwe 7.00"), (3, "Net 9.00")],
        "file_id int, text string")
    read = spark.createDataFrame([(1, 1, None, None, None)], f"file_id int, seq int, {money}")
    fixed = spark.createDataFrame(
        [(1, 1, " a ,", None, None, D(500)), (2, 1, "B", None, None, D(7)), (3, 1, "C", None, None, D(9))],
        f"file_id int, seq int, vendor string, {money}")
    got = learning.lessons(texts, read, fixed, vendors).collect()
    assert [tuple(r) for r in got] == [("a", "total", "bill value")]
    known = spark.createDataFrame(
        [(v, "total", "bill value") for v in "abc"] + [("a", "tax", "levy")],
        "vendor_key string, field string, label string")
    assert [(r.label, r.vendors) for r in learning.shared_labels(known).collect()] == [("bill value", 3)]
    receipts = spark.createDataFrame(
        [(1, "Z", None, None, None, None, None, 0, 0.2, "Bill Value: 12.00\nBill value 13.00\nLevy 3.00")],
        f"id int, vendor string, receipt_number string, receipt_date date, {money}, items int, "
        "confidence double, text string")  # fmt: skip
    done = learning.apply_learned(receipts, known, vendors).first()
    assert (done.total, done.tax, done.confidence) == (D("12.00"), None, 0.5)


# --- SQL names, streams --------------------------------------------------------------------------------


def test_parsers_in_sql(spark):
    sqlnames.register_sql_functions(spark)
    row = spark.sql(
        "SELECT fy_start(DATE '2026-02-01') a, within_a_rupee(1.5, 2.5) b, safe_cell('=x') c, "
        "clean_text('  a   b ') d"
    ).first()
    assert tuple(row) == (dt.date(2025, 4, 1), True, "'=x", "a b")


def test_sql_parsers_agree_with_their_columns(spark):
    printed = ["₹1,23,456.50", "(45.5)", "Rs. 99/-", "--7", "12.345.6", "x", "", None, " :INV-7/12#. ", "no digits", "\u00a0Ram  & Sons,|",
               "3 Feb 2001", "03/02/01", "2001-02-30", "31.4.2001 or 1st march, 2002", "Sept 5, 1999", "5\u0001/6/2020", "٣/٢/٢٠٠١", "Jan 32, 2001"]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(printed)], "id int, v string")
    sqlnames.register_sql_functions(spark)
    names = {"total": "parse_amount", "receipt_date": "parse_date", "vendor": "clean_vendor", "receipt_number": "clean_receipt_number"}
    columns = sqlnames.with_parsers(rows, {n: (n, "v") for n in names}).select("id", *names).collect()
    in_sql = rows.selectExpr("id", *[f"{f}(v) AS {n}" for n, f in names.items()]).collect()
    assert sorted(in_sql) == sorted(columns)
    cells = spark.createDataFrame([(v,) for v in ("=1", "5", "-2", "@x", "\tx", "a=b", ",", None)], "v string")
    assert cells.filter(F.expr("safe_cell(v)") != text.safe_cell(F.col("v"))).isEmpty()


def test_streams_take_each_file_once_and_drop_known_hashes(spark, tmp_path):
    schema = "sha256 string, id bigint"
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    seen = defaultdict(list)
    for number, rows in enumerate([[("x", 2), ("x", 1), ("y", 3)], [("y", 2), ("z", 5)], [("z", 4), ("x", 0), ("w", 9)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        jobs.ingest_unique(jobs.read_files(spark, source, schema), out, state)
        for r in jobs.batches(spark, out, schema).collect():
            seen[number].append((r.sha256, r.id))
    assert sorted(seen[0]) == [("x", 1), ("y", 3)]
    assert sorted(seen[1]) == [("x", 1), ("y", 3), ("z", 5)]
    assert sorted(seen[2]) == [("w", 9), ("x", 1), ("y", 3), ("z", 5)]


def test_snapshots_hold_the_batches_before_them(spark, tmp_path):
    schema = "file_id bigint, event_id bigint, status string, ts timestamp"
    kept = "file_id bigint, status string, ts timestamp"
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    write = jobs.to_snapshots(out, kept, ["file_id"], every=2)
    expected = {}
    for number in range(5):
        rows = [(f, number * 10 + f, f"s{number}", dt.datetime(2026, 8, 1 + number)) for f in range(number, 8, number + 1)]
        expected |= {r[0]: r[2] for r in rows}
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        jobs.run(jobs.latest_status(jobs.read_files(spark, source, schema)), write, state, "update")
        assert {r.file_id: r.status for r in jobs.latest(spark, out, kept, ["file_id"]).collect()} == expected
    assert sorted(p.name for p in (tmp_path / "out" / "snapshots").iterdir()) == ["1", "3"]
    # A repeated batch changes nothing, and batches that a snapshot holds are not read again.
    again = [(f, "s3", dt.datetime(2026, 8, 4)) for f in (3, 7)]
    write(spark.createDataFrame(again, kept), 3)
    found = jobs.latest(spark, out, kept, ["file_id"])
    assert {r.file_id: r.status for r in found.collect()} == expected
    assert "(batch#" in plan_of(found) and "> 3)" in plan_of(found)


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    schema = "ts timestamp"
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    dropped = 0
    for stamp in ("2026-08-05 10:00:00", "2026-08-06 10:00:00", "2026-08-01 10:00:00"):
        df = spark.sql(f"SELECT TIMESTAMP '{stamp}' AS ts")
        df.coalesce(1).write.mode("append").parquet(source)
        stream = jobs.used_per_local_day(jobs.read_files(spark, source, schema))
        done = jobs.run(stream, jobs.to_snapshots(out, "day date, used bigint", ["day"]), state, "update")
        dropped += sum(o["numRowsDroppedByWatermark"] for p in done.recentProgress for o in p["stateOperators"])
    used = {r.day: r.used for r in jobs.latest(spark, out, "day date, used bigint", ["day"]).collect()}
    assert used == {dt.date(2026, 8, 5): 1, dt.date(2026, 8, 6): 1} and dropped == 1


def test_every_query_has_a_name_and_most_have_sql():
    assert sum(1 for q in QUERIES.values() if q.sql) >= 0.9 * len(QUERIES)


def test_tries_do_not_depend_on_the_order_or_chunks_of_events():
    start = pd.Timestamp("2026-01-01 10:00")
    events = [(0, "failed"), (4, "failed"), (5, "failed"), (1, "parsed")]
    rows = [(start + pd.Timedelta(minutes=m), s) for m, s in events] + [(start - pd.Timedelta(minutes=m), "failed") for m in range(1, 12_000)]
    whole = pd.DataFrame(rows, columns=["ts", "status"])
    ms = lambda m: int((start + pd.Timedelta(minutes=m)).timestamp() * 1000)
    for order in (whole, whole.iloc[::-1]):
        for size in (2, 10_000, 20_000):
            chunks = (order.iloc[i : i + size].reset_index(drop=True) for i in range(0, len(order), size))
            status, at, ok, failed = jobs.tried(chunks, "", 0, -1, [])
            assert (status, at, ok, sum(t > ok for t in failed)) == ("failed", ms(5), ms(1), 2)


def test_starts_that_can_be_labels(spark):
    from billmill.operators import learning

    rows = [("grand total: 5 rs",), ("a-b c",), ("x",), ("änd 1",)]
    df = spark.createDataFrame(rows, "t string")
    got = [r[0] for r in df.select(learning.starts_of(F.col("t"), 13)).collect()]
    assert got == [["grand", "grand total", "grand total:", "grand total: "][:3], ["a", "a-b", "a-b c"], ["x"], ["änd", "änd 1"]]


def test_a_correction_closes_flags_and_leaves_refused_files_alone(spark):
    receipt = "id long, file_id long, run_id long, seq int, ref_no string, vendor string, receipt_number string, receipt_date date, subtotal decimal(12,2), tax decimal(12,2), total decimal(12,2), category_override_id long"
    day = dt.date(2001, 5, 2)

    def row(id, file, run, total, category=None):
        return (id, file, run, 1, f"R-{id}", "Kiran Stores", f"K{id}", day, D(90), D(10), D(total), category)

    stored = [row(i, i, i * 10, 100) for i in (1, 2, 3)]
    edits = [row(11, 1, 91, 140), row(12, 2, 92, 100), row(13, 3, 93, 100, 77)]
    tables = {
        "receipts": spark.createDataFrame(stored, receipt),
        "runs": spark.createDataFrame(
            [(i * 10, i, "csv", True, True, None, None) for i in (1, 2, 3)],
            "id long, file_id long, parser string, accepted boolean, has_result boolean, finished_at timestamp, created_at timestamp"),
        "flags": spark.createDataFrame(
            [(i, i, i, "validation_failed", "warning", "look", f"{i}:1:date", False, None, None) for i in (1, 2, 3)],
            "id long, file_id long, receipt_id long, type string, severity string, detail string, dedupe_key string, resolved boolean, resolved_by string, resolved_at timestamp"),
        "files": spark.createDataFrame(
            [(1, "flagged", "bad", None), (2, "processing", None, None), (3, "needs_review", None, None)],
            "id long, status string, error string, status_changed_at timestamp"),
        "categories": spark.createDataFrame([(5,)], "id long"),
    }

    def named(receipts, files):
        status = files.select(F.col("id").alias("file_id"), "status")
        return receipts.withColumns({
            "normalized_name": F.col("vendor"), "items": F.lit(0), "items_total": F.lit(None).cast("decimal(14,2)"),
        }).join(status, "file_id")

    now = F.lit("2001-08-01 00:00:00").cast("timestamp")
    after = compare.correct(
        spark.createDataFrame(edits, receipt), tables, named, user="mira", now=now, today=F.lit(dt.date(2001, 8, 1)))
    assert {tuple(r) for r in after["refused"].collect()} == {(2, "busy"), (3, "unknown_category")}
    assert sorted(r.id for r in after["receipts"].collect()) == [2, 3, 11]
    assert {(r.id, r.status, r.error) for r in after["files"].collect()} == {
        (1, "resolved", None), (2, "processing", None), (3, "needs_review", None)}
    flags = {(r.file_id, r.type, r.resolved, r.resolved_by) for r in after["flags"].collect()}
    assert flags == {
        (1, "validation_failed", True, "mira"), (1, "arithmetic_mismatch", True, "mira"),
        (2, "validation_failed", False, None), (3, "validation_failed", False, None)}
    assert {(r.id, r.accepted) for r in after["runs"].collect()} == {(10, False), (91, True), (20, True), (30, True)}

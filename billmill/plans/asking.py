"""Named queries: question texts tagged with filters and answered."""

from pyspark.sql import functions as F

from billmill.functions import dates, money
from billmill.operators import questions as ops
from billmill.plans.registry import query
from billmill.sources import bindings as b

# One question per customer, by number: what is asked and what it means.
TEMPLATES = [
    "'Receipts from ' || name || ' in march 1998'",
    "'machinery over ₹5,000 last financial year?'",
    "'between 1000 and 50,000 in 2000'",
    "'top 5 receipts this financial year'",
    "'furniture bills since 1 may 2001'",
    "'hello world'",
    "'spent at ' || name || ' between 1 aug 1999 and 15 aug 2000'",
    "'under 2 lakh last 3 months urgently'",
    "'fuel and building in 2001 yesterday'",
    "'biggest household bills, before 1995-06-30'",
]


def asked(spark, d):
    n = F.col("c_custkey")
    name = F.concat(F.lit("trader "), F.lpad((n % 100).cast("string"), 3, "0"))
    texts = F.lit(None).cast("string")
    for i, template in enumerate(TEMPLATES):
        parts = [p.strip() for p in template.split("||")]
        said = F.concat(*[name if p == "name" else F.lit(p[1:-1]) for p in parts])
        texts = F.when(n % 10 == i, said).otherwise(texts)
    return b.table(spark, d, "customer").select(n.alias("qid"), texts.alias("question"))


def tagged(spark, d):
    v = b.vendors(spark, d).select(F.col("normalized_name").alias("vendor")).distinct()
    return ops.tag(asked(spark, d), b.today(), b.categories(spark, d), v)


WHICH = "c_custkey % 10"
VENDOR = """(SELECT normalized_name FROM vendors v WHERE lower(v.normalized_name)
    = 'trader ' || lpad(CAST(c_custkey % 100 AS VARCHAR), 3, '0') LIMIT 1)"""
TAGGED = f"""(SELECT c_custkey AS qid,
    CASE {WHICH} WHEN 0 THEN DATE '1998-03-01' WHEN 1 THEN DATE '2000-04-01' WHEN 2 THEN DATE '2000-01-01'
      WHEN 3 THEN DATE '2001-04-01' WHEN 4 THEN DATE '2001-05-01' WHEN 6 THEN DATE '1999-08-01'
      WHEN 7 THEN DATE '2001-05-02' END AS date_from,
    CASE {WHICH} WHEN 0 THEN DATE '1998-03-31' WHEN 1 THEN DATE '2001-03-31' WHEN 2 THEN DATE '2000-12-31'
      WHEN 6 THEN DATE '2000-08-15' WHEN 9 THEN DATE '1995-06-29' ELSE DATE '2001-08-01' END AS date_to,
    CASE {WHICH} WHEN 1 THEN 5000.00 WHEN 2 THEN 1000.00 END AS min_total,
    CASE {WHICH} WHEN 2 THEN 50000.00 WHEN 7 THEN 200000.00 END AS max_total,
    CASE WHEN {WHICH} IN (0, 6) THEN {VENDOR} END AS vendor,
    CASE {WHICH} WHEN 1 THEN 'MACHINERY' WHEN 4 THEN 'FURNITURE' WHEN 9 THEN 'HOUSEHOLD' END AS category,
    CASE WHEN {WHICH} IN (3, 9) THEN 'amount' ELSE 'date' END AS sort,
    CASE {WHICH} WHEN 3 THEN 5 END AS top, CASE {WHICH} WHEN 7 THEN 'urgently' ELSE '' END AS ignored
  FROM customer WHERE {WHICH} NOT IN (5, 8))"""


@query("job17_tagged_questions", f"SELECT * FROM {TAGGED}")
def _(spark, d):
    rows = tagged(spark, d).filter("refused IS NULL")
    return rows.select(
        "qid", "date_from", "date_to", "min_total", "max_total", "vendor", "category", "sort",
        F.col("limit").alias("top"), F.array_join("ignored", " ").alias("ignored"))


@query("job17_refused_questions", f"""SELECT c_custkey AS qid, CASE {WHICH} WHEN 5 THEN 'Could not understand that question.'
    ELSE 'Ask about one period at a time.' END AS refused FROM customer WHERE {WHICH} IN (5, 8)""")
def _(spark, d):
    rows = tagged(spark, d).filter("refused IS NOT NULL")
    return rows.select("qid", F.regexp_extract("refused", r"^[^.]*\.", 0).alias("refused"))


MATCHES = f"""(SELECT q.qid, q.top, r.total, row_number() OVER (PARTITION BY q.qid
      ORDER BY CASE WHEN q.sort = 'amount' THEN -r.total END, r.receipt_date, r.ref_no) AS n
    FROM {TAGGED} q JOIN receipt_view r ON r.status IN ('parsed', 'resolved')
      AND r.receipt_date <= q.date_to AND (q.date_from IS NULL OR r.receipt_date >= q.date_from)
      AND (q.vendor IS NULL OR r.vendor = q.vendor) AND (q.category IS NULL OR r.category = q.category)
      AND (q.min_total IS NULL OR r.total >= q.min_total) AND (q.max_total IS NULL OR r.total <= q.max_total))"""


@query("job17_answered_questions", f"""SELECT q.qid, count(m.n) AS receipts,
      CAST(coalesce(sum(m.total), 0) AS DECIMAL(18,2)) AS sum_total,
      CAST(round_even(CAST(sum(m.total) AS DOUBLE) / count(m.n), 2) AS DECIMAL(18,2)) AS average_total
    FROM {TAGGED} q LEFT JOIN {MATCHES} m ON m.qid = q.qid AND (m.top IS NULL OR m.n <= m.top) GROUP BY 1""")
def _(spark, d):
    return ops.answer(tagged(spark, d), b.receipt_view(spark, d))


@query("str18_period_labels", f"""SELECT qid, CASE WHEN date_from IS NULL THEN 'before 30 Jun 1995'
    WHEN qid % 10 = 2 THEN 'The year 2000' ELSE CASE qid % 10 WHEN 1 THEN 'Last financial year, ' WHEN 3 THEN
      'This financial year, ' ELSE '' END || strftime(date_from, '%-d %b %Y') || ' to '
      || strftime(date_to, '%-d %b %Y') END AS label FROM {TAGGED}""")
def _(spark, d):
    return tagged(spark, d).filter("refused IS NULL").select("qid", F.col("period_label").alias("label"))


@query("udf3_rule_table", f"SELECT c_custkey AS qid, {WHICH} IN (1, 3) AS names_financial_year FROM customer")
def _(spark, d):
    rules = [r for r in ops.PERIODS if r.name == "financial year"]
    rows = asked(spark, d).select(
        "qid", ops.plain_question(F.col("question")).alias("text"),
        F.lit(None).cast("struct<start:date,end:date,label:string,problem:string>").alias("period"),
        F.lit(0).alias("periods"), F.lit(None).cast("string").alias("refused"))
    for rule in rules:
        rows = ops.apply_period(rows, rule, b.today())
    return rows.select("qid", (F.col("periods") > 0).alias("names_financial_year"))


@query("set3_words_in_order", """SELECT qid, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), ' ') AS words
    FROM (SELECT o_orderkey AS qid, ['b' || (o_orderkey % 3), 'a' || (o_orderkey % 2), 'b' || (o_orderkey % 5), 'a0'] AS w FROM orders)""")
def _(spark, d):
    n = F.col("o_orderkey")
    word = lambda p, m: F.concat(F.lit(p), (n % m).cast("string"))
    words = F.array(word("b", 3), word("a", 2), word("b", 5), F.lit("a0"))
    return b.table(spark, d, "orders").select(
        n.alias("qid"), F.array_join(F.array_distinct(words), " ").alias("words"))


# --- dates and amounts as written in questions -------------------------------------------------


def written(spark, d, text):
    return b.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("day"), text.alias("t"))


@query("dat11_dates_as_written", """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 6 THEN NULL
    WHEN o_orderkey % 7 = 5 AND (month(o_orderdate), day(o_orderdate)) = (2, 29) THEN NULL -- 2001 has none
    WHEN o_orderkey % 7 = 5 THEN make_date(CASE WHEN (month(o_orderdate), day(o_orderdate)) <= (8, 1) THEN 2001 ELSE 2000 END,
      month(o_orderdate), day(o_orderdate)) ELSE CAST(o_orderdate AS DATE) END AS day FROM orders""")
def _(spark, d):
    day, n = F.col("o_orderdate").cast("date"), F.col("o_orderkey") % 7
    form = lambda f: F.lower(F.date_format(day, f))
    said = (F.when(n == 0, form("yyyy-MM-dd")).when(n == 1, form("d/M/yyyy")).when(n == 2, form("d.MM.yyyy"))
            .when(n == 3, F.concat(form("d"), F.lit("th of "), form("MMMM yyyy"))).when(n == 4, form("MMM d, yyyy"))
            .when(n == 5, form("d MMM")).otherwise(F.lit("31/02/2001")))
    return written(spark, d, said).select("id", ops.parse_date(F.col("t"), b.today()).alias("day"))


def read_period(spark, d, said, rule):
    found = next(r for r in ops.PERIODS if r.name == rule)
    rows = written(spark, d, F.concat(F.lit(" "), said, F.lit(" ")))
    group = lambda i: F.regexp_extract("t", found.pattern, i)
    day = F.col("day")
    return rows.withColumn("p", found.period(group, day)).select("id", "p.start", "p.end", "p.label")


def read_month(spark, d, said, is_may):
    """Months by their rule; May, which is also a verb, has its own."""
    by = {name: next(r for r in ops.PERIODS if r.name == name) for name in ("month", "may")}
    rows = b.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("day"),
        F.concat(F.lit(" "), said, F.lit(" ")).alias("t"), is_may.alias("is_may"))
    read = {name: rule.period(lambda i, p=rule.pattern: F.regexp_extract("t", p, i), F.col("day")) for name, rule in by.items()}
    found = rows.withColumn("p", F.when(F.col("is_may"), read["may"]).otherwise(read["month"]))
    return found.select("id", "p.start", "p.end", "p.label")


SPAN = "strftime(start, '%-d %b %Y') || ' to ' || strftime(\"end\", '%-d %b %Y')"


def ranges(name, start, end, label=SPAN):
    return f"""SELECT id, start, "end", {label} AS label FROM (SELECT o_orderkey AS id, CAST({start} AS DATE) AS start,
      CAST({end} AS DATE) AS "end", CAST(o_orderdate AS DATE) AS day FROM orders)"""


@query("dat6_last_week", ranges("", "date_trunc('week', o_orderdate) - INTERVAL 7 DAY", "date_trunc('week', o_orderdate) - INTERVAL 1 DAY"))
def _(spark, d):
    return read_period(spark, d, F.lit("last week"), "relative")


@query("dat6_last_month", ranges("", "date_trunc('month', o_orderdate) - INTERVAL 1 MONTH", "date_trunc('month', o_orderdate) - INTERVAL 1 DAY"))
def _(spark, d):
    return read_period(spark, d, F.lit("previous month"), "relative")


@query("dat6_this_year", ranges("", "date_trunc('year', o_orderdate)", "o_orderdate"))
def _(spark, d):
    return read_period(spark, d, F.lit("this year"), "relative")


@query("dat6_last_financial_year", ranges("", "date_trunc('year', o_orderdate - INTERVAL 3 MONTH) - INTERVAL 9 MONTH",
       "date_trunc('year', o_orderdate - INTERVAL 3 MONTH) + INTERVAL 3 MONTH - INTERVAL 1 DAY", "'Last financial year, ' || " + SPAN))
def _(spark, d):
    return read_period(spark, d, F.lit("last fy"), "financial year")


@query("dat5_named_financial_year", ranges("", "make_date(2000 + o_orderkey % 30, 4, 1)", "make_date(2001 + o_orderkey % 30, 3, 31)",
       "'Financial year ' || year(start) || '-' || strftime(\"end\", '%y') || ', ' || " + SPAN))
def _(spark, d):
    said = F.concat(F.lit("fy "), F.lpad((F.col("o_orderkey") % 30).cast("string"), 2, "0"), F.lit("-99"))
    return read_period(spark, d, said, "named year")


@query("dat7_last_n", ranges("", """CASE o_orderkey % 3 WHEN 0 THEN o_orderdate - to_days(CAST(o_orderkey % 40 AS INT))
    WHEN 1 THEN o_orderdate - to_days(CAST((o_orderkey % 40 + 1) * 7 - 1 AS INT))
    ELSE o_orderdate - to_months(CAST(o_orderkey % 40 + 1 AS INT)) + INTERVAL 1 DAY END""", "o_orderdate"))
def _(spark, d):
    unit = F.element_at(F.array(F.lit(" days"), F.lit(" weeks"), F.lit(" months")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    said = F.concat(F.lit("past "), (F.col("o_orderkey") % 40 + 1).cast("string"), unit)
    return read_period(spark, d, said, "last n")


@query("dat8_month_without_year", ranges("", """make_date(year(o_orderdate) - CASE WHEN o_orderkey % 12 + 1 <= month(o_orderdate)
    THEN 0 ELSE 1 END, o_orderkey % 12 + 1, 1)""", """last_day(make_date(year(o_orderdate) - CASE WHEN o_orderkey % 12 + 1 <= month(o_orderdate)
    THEN 0 ELSE 1 END, o_orderkey % 12 + 1, 1))"""))
def _(spark, d):
    number = (F.col("o_orderkey") % 12 + 1).cast("int")
    month = F.date_format(F.make_date(F.lit(2000), number, F.lit(1)), "MMMM")
    return read_month(spark, d, F.concat(F.lit("in "), F.lower(month)), number == 5)


@query("dat14_whole_month_and_year", ranges("", "date_trunc('month', o_orderdate)", "last_day(o_orderdate)"))
def _(spark, d):
    said = F.lower(F.date_format("o_orderdate", "MMM yyyy"))
    return read_month(spark, d, said, F.month(F.col("o_orderdate").cast("date")) == 5)


@query("dat12_backward_ranges", ranges("", "o_orderdate - INTERVAL 1 YEAR", "o_orderdate - INTERVAL 10 DAY"))
def _(spark, d):
    day = F.col("o_orderdate").cast("date")
    said = F.concat(F.lit("from "), F.lower(F.date_format(day, "d MMM")), F.lit(" to "),
                    F.date_format(F.date_sub(day, 10), "yyyy-MM-dd"))
    # Read on the day itself: the start has no year and would come after the end.
    return read_period(spark, d, said, "range")


@query("dat13_since_and_before", """SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN CAST(o_orderdate AS DATE)
      WHEN 1 THEN CAST(o_orderdate + INTERVAL 1 DAY AS DATE) END AS start,
    CASE o_orderkey % 3 WHEN 2 THEN CAST(o_orderdate - INTERVAL 1 DAY AS DATE) ELSE CAST(o_orderdate AS DATE) END AS "end" FROM orders""")
def _(spark, d):
    word = F.element_at(F.array(F.lit("since "), F.lit("after "), F.lit("before ")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    said = F.concat(word, F.date_format("o_orderdate", "yyyy-MM-dd"))
    return read_period(spark, d, said, "since").drop("label")


@query("num4_amount_words", """SELECT o_orderkey AS id, CAST((o_orderkey % 500 + 0.5) * CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 1000
    ELSE 100000 END AS DECIMAL(14,2)) AS amount FROM orders""")
def _(spark, d):
    n = F.col("o_orderkey")
    unit = F.element_at(F.array(F.lit(""), F.lit("k"), F.lit("lakhs")), (n % 3 + 1).cast("int"))
    number = F.concat((n % 500).cast("string"), F.lit(".5"))
    return b.table(spark, d, "orders").select(n.alias("id"), money.amount_with_unit(number, unit).alias("amount"))


@query("num8_amount_conditions", """SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 2 THEN NULL ELSE CAST(o_orderkey AS DECIMAL(14,2)) END AS min_total,
    CASE o_orderkey % 3 WHEN 0 THEN CAST(o_orderkey + 7000 AS DECIMAL(14,2)) WHEN 2 THEN CAST(o_orderkey AS DECIMAL(14,2)) END AS max_total FROM orders""")
def _(spark, d):
    n = F.col("o_orderkey")
    said = (F.when(n % 3 == 0, F.concat(F.lit(" between "), F.format_number(n + 7000, 0), F.lit(" and "), n.cast("string"), F.lit(" ")))
            .when(n % 3 == 1, F.concat(F.lit(" at least rs. "), n.cast("string"), F.lit(" ")))
            .otherwise(F.concat(F.lit(" up to "), n.cast("string"), F.lit(" rupees "))))
    rows = b.table(spark, d, "orders").select(n.alias("id"), said.alias("text"))
    return ops.apply_amounts(rows).select("id", "min_total", "max_total")


@query("dat4_months", """SELECT o_orderkey AS id, last_day(o_orderdate) AS month_end,
    CAST(CAST(o_orderdate AS DATE) + to_months(CAST(o_orderkey % 30 - 15 AS INT)) AS DATE) AS shifted FROM orders""")
def _(spark, d):
    n, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    return b.table(spark, d, "orders").select(
        n.alias("id"), dates.month_end(day).alias("month_end"),
        F.add_months(day, (n % 30 - 15).cast("int")).alias("shifted"))


@query("pre9_refused_filters", f"SELECT {WHICH} NOT IN (5, 8) AS usable, count(*) AS questions FROM customer GROUP BY 1")
def _(spark, d):
    # The questions whose own filters contradict each other are refused before any plan is run.
    rows = tagged(spark, d)
    return rows.groupBy(F.col("refused").isNull().alias("usable")).agg(F.count("*").alias("questions"))


"""Facts of projects with their sources: conflicts, edited values, what follows from others, empty tables."""

from pyspark.sql import functions as F

from ledgerloom.plans import summary

DOCS = "doc_id long, project_id long, category string, date string, title string, status string, doc_no string"
FACTS = "doc_id long, field string, value string, page int, edited boolean"
PROJECTS = "id long, name string, code string, employer string, contractor string, consultant string, contract_amount long, start_date string, end_date string"


def tables(spark):
    docs = [
        (1, 1, "contract", "1402/01/01", "first", "ready", "77/1"), (2, 1, "contract", "1402/06/01", "second", "ready", "77/2"), (3, 1, "invoice", "1402/07/01", "inv 2", "ready", "2"), (4, 1, "invoice", "1402/08/01", "inv 10", "ready", "10"),
        (5, 1, "guarantee", "1402/02/01", "g", "ready", None), (6, 1, "letter", "1402/09/01", "l", "queued", None), (7, 2, "contract", "1402/01/01", "other", "ready", None), (8, None, "report", "1402/01/01", "loose", "ready", "9"),
    ]
    facts = [
        (1, "doc_no", "77/1", 1, False), (1, "employer", "read", 1, False), (1, "employer", "by hand", None, True), (1, "consultant", " ", 1, False), (1, "duration", "۱۸ ماه", 4, False), (1, "start_date", "1402/01/31", 4, False),
        (2, "employer", "later", 1, True), (2, "amount", "5", 1, False), (3, "contract_total", "1000", 2, False), (3, "work_total", "250", 2, False), (4, "contract_total", "2000", 3, None), (4, "work_total", "500", 3, False), (4, "contract_total", "3000", 2, None),
        (5, "valid_until", "1402/10/05", 1, False), (7, "amount", "900", 1, False), (7, "duration", "45 روز", 2, False), (8, "manpower", "12", 3, False), (99, "employer", "nobody's", 1, False),
    ]
    projects = [(1, "one", None, "", "kept", None, 0, "1400/01/01", None), (2, "two", "", "owner", None, None, 7, "1402/03/01", "1402/09/09"), (3, "none", None, None, None, None, None, None, None)]
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(facts, FACTS), spark.createDataFrame(projects, PROJECTS)


def test_facts_and_suggestions(spark):
    docs, facts, projects = tables(spark)
    found = summary.project_facts(docs, facts, projects).cache()
    got = {(r.project_id, r.key): (r.value, r.doc_id, r.page, r.edited, r.computed) for r in found.collect()}
    assert got == {
        (1, "contract_no"): ("77/1", 1, 1, False, False), (1, "employer"): ("by hand", 1, None, True, False), (1, "duration"): ("۱۸ ماه", 1, 4, False, False), (1, "start_date"): ("1402/01/31", 1, 4, False, False),
        (1, "end_date"): ("1403/07/30", 1, 4, False, True), (1, "contract_amount"): ("3000", 4, 2, False, True),
        (2, "contract_amount"): ("900", 7, 1, False, False), (2, "duration"): ("45 روز", 7, 2, False, False), (2, "end_date"): ("1402/04/15", 7, 2, False, True),
    }
    labels = {r.key: r.label for r in found.filter("project_id = 1").collect()}
    assert labels["contract_amount"] == "مبلغ قرارداد (طبق صورت‌وضعیت)" and labels["employer"] == "کارفرما"
    hints = {(r.project_id, r.field): r.value for r in summary.suggestions(found, projects).collect()}
    assert hints == {(1, "code"): "77/1", (1, "employer"): "by hand", (1, "end_date"): "1403/07/30", (1, "contract_amount"): "3000"}
    inv = [(r.doc_id, r.seq, r.total_pct) for r in summary.invoices(docs, facts, found, projects).orderBy("seq").collect()]
    assert inv == [(3, 1, 8.3), (4, 2, 16.7)]


def test_one_row_for_each_project(spark):
    docs, facts, projects = tables(spark)
    rows = {r.project_id: r for r in summary.summary(docs, facts, projects, F.lit("1402/09/20")).collect()}
    assert sorted(rows) == [1, 2, 3]
    one = rows[1]
    assert one.pending == 1 and one.documents == 6 and one.counts == {"contract": 2, "guarantee": 1, "invoice": 2}
    assert [f.key for f in one.facts] == ["contract_no", "employer", "contract_amount", "duration", "start_date", "end_date"]
    assert one.last_invoice.doc_id == 4 and [t.doc_id for t in one.timeline] == [4, 3, 2, 5, 1]
    assert rows[3].documents == 0 and rows[3].facts is None
    assert [(r.doc_id, r.state) for r in summary.guarantees(docs, facts, F.lit("1402/09/20")).collect()] == [(5, "soon")]
    assert {r.state for r in summary.guarantees(docs, facts, F.lit("1402/10/06")).collect()} == {"expired"}


def test_briefs_and_nothing(spark):
    docs, facts, projects = tables(spark)
    lines = [(r.doc_id, r.label, r.value, r.page) for r in summary.brief(docs, facts).orderBy("doc_id", "ord").collect()]
    assert (4, "مبلغ قرارداد", "3000", 2) in lines and (8, "نیروی انسانی", "12", 3) in lines and not [x for x in lines if x[0] == 6]
    assert [x[1] for x in lines if x[0] == 1] == ["شماره", "کارفرما", "مدت", "تاریخ شروع"]
    assert summary.project_facts(docs.limit(0), facts, projects).count() == 0
    assert summary.summary(docs.limit(0), facts.limit(0), projects, F.lit("1402/09/20")).count() == 3

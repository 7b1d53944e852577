"""Fields of monthly reports."""

from ledgerloom.plans import monthly

HEAD = "طرح راه جنوب شرق کشور"


def pages_of(*texts):
    return [(1, i + 1, t) for i, t in enumerate(texts)]


def test_fields_of_a_report(spark):
    rows = pages_of(
        f"{HEAD}\nگزارش ماهانه منتهی به شهریور ماه ۱۴۰۵\nشماره گزارش: AB-MR-013\nآغاز کار مهر 1402 و AB-XX-1 و AB-XX-1",
        f"{HEAD}\nفهرست\nاقدامات انجام شده\nمشکلات و موانع",
        f"{HEAD}\nاقدامات انجام شده\nردیف شرح عملیات\n1 خاکریزی محور اصلی راه ادامه\n000\n+\n15\n2 بتن ریزی پایه پل\n2 بتن ریزی پایه پل\nکوتاه است",
        f"{HEAD}\nمشکلات و موانع\nکمبود قیر در کارگاه\n1,240 40 جمع نفرات",
    )
    rows += [(2, 1, None), (3, 1, "خرداد 1404 و تیر 1404 و تیر 1404")]
    found = {r.doc_id: r for r in monthly.fields(spark.createDataFrame(rows, "doc_id int, page int, text string")).collect()}
    a = found[1]
    assert (a.report_no, a.period, a.until, a.man_days, a.man_avg) == ("AB-MR-013", "شهریور 1405", "1405/06/31", 1240, 40)
    assert a.done == ["خاکریزی محور اصلی راه (ادامه) + 15", "بتن ریزی پایه پل"] and a.problems == ["کمبود قیر در کارگاه"] and a.next is None
    assert a.subject == "گزارش ماهانه شهریور 1405" and a.points[1] == "مشکلات: کمبود قیر در کارگاه"
    assert found[2].report_no is None and found[2].period is None and found[2].points == []
    assert found[3].period == "تیر 1404" and found[3].until == "1404/04/31"


def test_month_and_year_in_different_lines(spark):
    df = spark.createDataFrame([(1, 1, "منتهی به\n1403\nدوره\nاسفند ماه")], "doc_id int, page int, text string")
    r = monthly.fields(df).first()
    assert (r.period, r.until) == ("اسفند 1403", "1403/12/30")
    assert monthly.fields(df.limit(0)).count() == 0


def test_no_piece_of_a_report_is_sent_to_all_tasks(spark):
    """Files of few bytes hold many lines, whose size Spark takes to be that of the file."""
    from ledgerloom.queries import QUERIES
    from tests.oracle import DATA

    assert "BroadcastHashJoin" not in QUERIES["report_fields"](spark, DATA)._jdf.queryExecution().executedPlan().toString()


def test_orders_are_dealt_before_they_are_texts(spark):
    """Small files of orders made few tasks, which wrote and searched all pages; pages that can't hold a date were folded sign by sign."""
    from ledgerloom.queries import QUERIES
    from tests.oracle import DATA

    plan = QUERIES["report_fields"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    scans = plan.count("Relation [")
    assert scans and plan.count("RepartitionByExpression [o_orderkey") == scans
    odd = [(1, 1, "منتهی به مهر ماه سال ۱۴۰۲ و A-1"), (2, 1, "AB-C-1x AB-C-1"), (3, 1, "۱٬۲۴۰ 900 ۳۰ جمع نفرات"), (4, 1, "no hit"), (5, 1, None)]
    found = {r.doc_id: (r.report_no, r.period, r.man_days, r.man_avg) for r in monthly.fields(spark.createDataFrame(odd, "doc_id int, page int, text string")).collect()}
    assert found == {1: (None, "مهر 1402", None, None), 2: ("AB-C-1", None, None, None), 3: (None, None, 900, 30), 4: (None,) * 4, 5: (None,) * 4}

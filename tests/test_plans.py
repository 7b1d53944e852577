"""Plans against plain models."""

import datetime
import random

from pyspark.sql import functions as F

from ledgerloom.operators import listing, running, sets
from ledgerloom.plans import importing, journal, reports, retrieval
from ledgerloom.sources import tables
from ledgerloom.streaming import queue


def test_outstanding_and_receivable_differ(spark):
    rows = spark.createDataFrame([(1, 0, 100, 0, "submitted"), (2, None, 100, 20, "submitted")], "id int, approved_amount long, net_amount long, paid_amount long, status string")
    assert [r.o for r in rows.select(reports.outstanding().alias("o")).collect()] == [100, 80]
    assert reports.receivable(rows).first().receivable == 80


def test_raw_category_keys_stay_apart(spark):
    rows = spark.createDataFrame([("income", None, 1), ("income", "none", 2)], "kind string, category string, amount long")
    assert reports.by_kind(rows, "category").count() == 2


def test_bag_difference(spark):
    new = spark.createDataFrame([(i, "a", None) for i in range(3)] + [(9, "b", "x")], "id int, k string, v string")
    stored = spark.createDataFrame([("a", None), ("a", None), ("c", "x")], "k string, v string")
    assert [r.id for r in sets.bag_difference(new, stored, ["k", "v"], [F.col("id")]).orderBy("id").collect()] == [2, 9]


def test_running_states_match_a_loop(spark):
    rng = random.Random(4)
    day0 = datetime.date(2024, 1, 1)
    rows = [(i, day0 + datetime.timedelta(days=rng.randrange(20)), rng.random() < 0.2, rng.randrange(-500, 600)) for i in range(300)]
    rows[0] = (0, day0, True, 5000)
    df = spark.createDataFrame(rows, "id int, at date, is_transfer boolean, amount long").withColumns({"rank": F.when(F.col("is_transfer"), 0).otherwise(1), "transfer": F.when(F.col("is_transfer"), F.col("amount")).otherwise(0)})
    order = [F.col("rank"), F.col("id")]
    line = running.running_total(running.running_total(df, "at", order, "amount", "balance"), "at", order, "transfer", "transfers")
    balance, transfers, peak, worst, want = 0, 0, None, 0.0, {}
    for i, _, t, a in sorted(rows, key=lambda r: (r[1], not r[2], r[0])):
        balance += a
        transfers += a if t else 0
        want[i] = balance
        if not t:
            peak = balance - transfers if peak is None else max(peak, balance - transfers)
            if transfers + peak > 0:
                worst = max(worst, 100 * (transfers + peak - balance) / (transfers + peak))
    assert {r.id: r.balance for r in line.collect()} == want
    assert abs(running.drawdown(line, "at", order).first().max_drawdown - worst) < 1e-9


def test_trade_metrics_with_partial_exits(spark):
    trade = [(1, "long", 100.0, 50.0, 10.0, 0.1, 95.0, 0.0, [(110.0, 50.0, None, None), (120.0, None, 0.2, None)]), (2, "short", 100.0, 50.0, 1.0, None, 100.0, 90.0, [])]
    schema = "id int, side string, entry_price double, margin double, leverage double, entry_fee double, sl double, tp double, exits array<struct<price:double,pct:double,fee:double,at:date>>"
    a, b = journal.metrics(spark.createDataFrame(trade, schema)).orderBy("id").collect()
    qty = 5.0
    gross = qty * 0.5 * 10 + qty * 20
    fees = qty * 0.5 * 110 * 0.001 + 500 * 0.001 * 0.5 + qty * 120 * 0.002 + 500 * 0.001
    assert abs(a.net - (gross - fees)) < 1e-9 and a.status == "closed" and a.result == "win" and a.planned_r is None
    assert b.risk is None and b.status == "open" and b.result is None and b.net == 0


def test_each_exit_has_its_own_net(spark):
    schema = "id int, side string, entry_price double, margin double, leverage double, entry_fee double, sl double, tp double, opened_at date, exits array<struct<price:double,pct:double,fee:double,at:date>>"
    day = datetime.date(2024, 1, 1)
    trade = [(1, "long", 100.0, 1000.0, 1.0, 0.0, 0.0, 0.0, day, [(120.0, 50.0, None, day), (90.0, 50.0, None, None)])]
    made = journal.metrics(spark.createDataFrame(trade, schema))
    none = spark.createDataFrame([], "id long, day date, amount long")
    assert sorted(r.amount for r in journal.events(made, none).collect()) == [-5000, 10000]
    assert made.first().net == 50.0


def test_streaks_break_even_is_a_run(spark):
    results = ["win", "win", "be", "win", "loss", "loss", "loss", "win"]
    rows = spark.createDataFrame([(1, i, r) for i, r in enumerate(results)], "g int, ord int, result string")
    assert {r.result: r.longest for r in running.streaks(rows, ["g"], [F.col("ord")], "result").collect()} == {"win": 2, "be": 1, "loss": 3}


def frame(spark, header, *rows):
    return spark.createDataFrame([tuple(r) for r in rows], ", ".join(f"`{h}` string" for h in header))


def test_import_of_two_amount_columns(spark):
    raw = frame(spark, ["تاریخ", "شرح", "واریز (تومان)", "برداشت (ریال)"], ("1403/01/02", "a", "100", ""), ("1403/01/03", "b", "", "۲۰"), ("1403/01/03", "c", "", ""))
    got = [(r.tx_date, r.kind, r.amount, r.description) for r in importing.read_rows(raw).orderBy("description").collect()]
    assert got == [("1403/01/02", "income", 1000, "a"), ("1403/01/03", "expense", 20, "b")]


def test_import_kinds_totals_and_dateless_rows(spark):
    spent = frame(spark, ["تاریخ", "شرح هزینه", "مبلغ (تومان)", "دسته‌بندی", "خودرو", "توضیحات"], ("۱۴۰۵/۰۶/۰۱", "سرویس روغن", "5000000", "خودرو", "پراید", "فیلتر هوا"), ("۱۴۰۵/۰۶/۰۲", "نان", "250000", "خوراک", None, None), ("۱۴۰۵/۰۶/۰۳", "بنزین", "-60000", "خودرو", "نامشخص", None), (None, "جمع کل", "99", None, None, None))
    got = {r.description: r for r in importing.read_rows(spent, "ریز هزینه‌ها").collect()}
    assert set(got) == {"سرویس روغن — خودرو: پراید — فیلتر هوا", "نان", "بنزین"}
    assert got["بنزین"].kind == "income" and got["نان"].amount == 2_500_000 and got["نان"].kind == "expense"
    loans = frame(spark, ["تاریخ", "شرح", "مبلغ (تومان)", "نوع", "توضیحات"], ("۱۴۰۵/۰۶/۰۵", "از خانواده", "3000000", "تأمین مالی دریافتی", None), ("تاریخ دقیق نامشخص؛ ماه قبل", "قرض قبلی", "1000000", "بدهی/قرض دریافتی", None), ("۱۴۰۵/۰۶/۰۶", "بدهی", "500000", "بازپرداخت بدهی", None))
    rows = {r.description.split(" — ")[0]: r for r in importing.read_rows(loans).collect()}
    assert [rows[k].kind for k in ("از خانواده", "قرض قبلی", "بدهی")] == ["income", "income", "expense"]
    assert rows["قرض قبلی"].tx_date == "1405/06/04" and rows["قرض قبلی"].guessed and "تاریخ دقیق نامشخص" in rows["قرض قبلی"].description


def test_import_tells_tables_apart(spark):
    assert importing.table_kind(["تاریخ", "جمع هزینه (تومان)"]) == importing.table_kind(["دسته‌بندی", "جمع (تومان)"]) == "skipped"
    assert importing.find_header([["a", "b"], ["تاریخ", "شرح", "مبلغ"]]) == (1, "transactions") and importing.find_header([["x"]]) == (-1, "skipped")
    notes = frame(spark, ["موضوع", "جزئیات"], ("یادآوری", " در  پاییز"), (None, "x"))
    assert importing.table_kind(notes.columns) == "notes"
    found = importing.read_notes(notes)
    assert [tuple(r) for r in found.collect()] == [("یادآوری", "در پاییز")] and importing.new_notes(found, found).count() == 0


def test_free_text_wildcards_and_ascii_case(spark):
    rows = spark.createDataFrame([("Alpha_1",), ("ALPHA-2",), ("É",), (None,)], "name string")
    find = lambda t: rows.filter(listing.free_text(("name",), t)).count()
    assert find("alpha_") == 2 and find("é") == 0 and find("a%2") == 1


def test_clamp_and_upsert(spark):
    assert (listing.clamp(0), listing.clamp(5), listing.clamp(10**6)) == (1, 5, 1000)
    base = spark.createDataFrame([(1, "a", 1)], "id int, name string, n int")
    got = listing.upsert(base, spark.createDataFrame([(1, None, 7), (2, "b", None)], "id int, name string, n int"))
    assert sorted(map(tuple, got.collect())) == [(1, "a", 7), (2, "b", None)]


def test_fusion_prefers_the_first_list(spark):
    a = spark.createDataFrame([(1, 9.0), (2, 8.0)], "id int, score double")
    b = spark.createDataFrame([(3, 0.9), (1, 0.8)], "id int, score double")
    assert [r.id for r in retrieval.fuse(a, b, "id", 3).collect()] == [1, 3, 2]


def test_csv_encodings(spark, tmp_path):
    head = "عنوان"  # letters that all three encodings have
    for name, encoding, sep in (("a", "utf-8-sig", ";"), ("b", "utf-16", "\t"), ("c", "cp1256", ",")):
        (tmp_path / f"{name}.csv").write_bytes(f"{head}{sep}مبلغ\n1403/01/01{sep}5\n{sep}\n".encode(encoding))
        df = tables.read_delimited(spark, str(tmp_path / f"{name}.csv"))
        assert df.columns == [head, "مبلغ"] and [tuple(r) for r in df.collect()] == [("1403/01/01", "5")]


def test_queue_is_exactly_once_and_resumes(spark, tmp_path):
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    first = spark.createDataFrame([("One text. It has words.",), ("One text. It has words.",), ("",)], "text string")
    first.write.json(source)
    queue.run_queue(queue.file_stream(spark, source), out, mark).awaitTermination()
    spark.createDataFrame([("Another text, with words.",), ("One text. It has words.",)], "text string").write.mode("append").json(source)
    for _ in range(2):
        queue.run_queue(queue.file_stream(spark, source), out, mark).awaitTermination()
    chunks = spark.read.parquet(f"{out}/chunks")
    assert sorted(r.chunk for r in chunks.collect()) == ["Another text, with words.", "One text. It has words."]


def test_a_replayed_batch_writes_the_same(spark, tmp_path):
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    spark.createDataFrame([(f"Text number {i}. It has words.",) for i in range(5)] + [(None,)], "text string").write.json(source)
    run = lambda: queue.run_queue(queue.file_stream(spark, source), out, mark).awaitTermination()
    count = lambda: (spark.read.parquet(f"{out}/documents").count(), spark.read.parquet(f"{out}/chunks").count())
    run()
    first = count()
    for f in (tmp_path / "mark" / "commits").iterdir():  # as after a crash before the commit
        f.unlink()
    run()
    assert first == count() == (5, 5)


def test_order_of_work_versions_and_vectors(spark):
    rows = [(1, "queued", 5, 0, 0), (2, "queued", 3, None, 0), (3, "queued", 9, 2, 1), (4, "ready", 1, 0, None), (5, "ready", 1, 0, 7)]
    docs = spark.createDataFrame(rows, "id int, status string, size int, pages_done int, version int")
    assert [r.id for r in queue.in_order(docs).collect()] == [3, 2, 1]
    assert [r.id for r in queue.outdated(docs, 7).collect()] == [4]
    chunks = spark.createDataFrame([(1, 1, i, None if i < 70 else [1.0], "ready") for i in range(80)] + [(2, 1, 0, None, "queued")], "doc_id int, page int, seq int, vec array<float>, status string")
    assert {r["batch"]: r["count"] for r in queue.without_vectors(chunks).groupBy("batch").count().collect()} == {0: 64, 1: 6}


def test_retries_and_reminders(spark):
    pages = spark.createDataFrame([("a", 1), ("a", 2)], "sha string, page int")
    failures = spark.createDataFrame([("a", 2)] * 3, "sha string, page int")
    again, aside = queue.retry(pages, failures)
    assert [r.page for r in again.collect()] == [1] and [r.page for r in aside.collect()] == [2]
    tasks = spark.createDataFrame([(1, "1403/01/01 09:00", "todo"), (2, "1403/01/01 09:00", "done"), (3, "1403/02/01 09:00", "todo")], "id int, remind_at string, status string")
    sent = spark.createDataFrame([], "id int")
    due = queue.reminders(tasks, sent, "1403/01/02 00:00")
    assert [r.id for r in due.collect()] == [1] and queue.reminders(tasks, due, "1403/01/02 00:00").count() == 0
    assert queue.brief_due("1403/01/01 09:30", "08:00", None) and not queue.brief_due("1403/01/01 12:30", "08:00", None) and not queue.brief_due("1403/01/01 09:30", "08:00", "1403/01/01")

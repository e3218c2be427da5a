"""Raw files, literals and the streamed long tail."""

from __future__ import annotations

import collections
import datetime as dt
import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions.literals import joined, name_in, parse
from tidemark.plans import queries
from tidemark.plans.preparation import prepare
from tidemark.sources import intake
from tidemark.streaming import tail


@pytest.mark.parametrize(
    "text,value",
    [('["it\'s a", \'b\']', ["it's a", "b"]), ("['a', \"it's\"]", ["a", "it's"]), (r"{'name': 'O\'Brien'}", {"name": "O'Brien"}), ('{"a": [1, -2.5e1, true, null], "b": {}}', {"a": [1, -25.0, True, None], "b": {}}), ("(1,)", (1,)), ("('a' 'b')", "ab"), (r'"é\x41\t\101\q😀"', "éA\tA\\q😀"), ("[[], (), {1: 'x',},]", [[], (), {1: "x"}]), (" None ", None)],
)
def test_literals(text, value):
    assert parse(text) == value


@pytest.mark.parametrize("text", ["", "[", "['a", "['a' 'b", "[1 2]", "{1}", "{'a': }", "{'a' 1}", "[__import__('os')]", "a", "['a'] x", "{[1]: 2}", "'a\nb'", r"'\x4'", "[,]", "'"])
def test_malformed_literals(text):
    with pytest.raises(ValueError):
        parse(text)


def test_deep_literals_and_printed_values():
    parse("[" * 50_000 + "]" * 50_000)
    rng = random.Random(0)

    def make(depth):
        k = rng.randrange(9 if depth else 6)
        plain = [lambda: rng.randrange(-99, 99), lambda: rng.random() * 1e6, lambda: rng.choice([True, False, None])] + 3 * [lambda: "".join(rng.choice("ab'\"\\\n\té😀 ,:[]{}") for _ in range(rng.randrange(8)))]
        nested = [lambda: [make(depth - 1) for _ in range(rng.randrange(4))], lambda: tuple(make(depth - 1) for _ in range(rng.randrange(4))), lambda: {rng.choice(["name", "k", 1]): make(depth - 1) for _ in range(rng.randrange(4))}]
        return (plain + nested)[k]()

    for _ in range(2000):
        v = make(4)
        assert parse(repr(v)) == v
        assert json.loads(json.dumps(v)) == parse(json.dumps(v))


def test_names_and_lists_from_literals(spark):
    assert name_in("{'x': 1}", 50) == "" and name_in("{'name': None}", 50) == "" and name_in("{broken" + "x" * 60, 50) == ("{broken" + "x" * 60)[:50] and name_in("{'a', 'b'}", 50) == "{'a', 'b'}"
    assert joined("['a', None, 2, ['b']]", 200) == "a None 2 ['b']" and joined("[" + "1, " * 200 + "]", 9) == "1 1 1 1 1" and joined("[bad", 3) == "[ba"
    row = spark.range(1).select(*(T.author_name(F.lit(x)) for x in (r"{'name': 'O\'B'}", "plain", None)), *(T.description_text(F.lit(x)) for x in ('["it\'s", \'b\']', "plain", None))).first()
    assert list(row) == ["O'B", "plain", "", "it's b", "plain", ""]


def test_stamps_that_are_no_digits_are_kept(spark):
    df = spark.createDataFrame([("10",), ("9",), ("x",), (None,), ("b",), ("1" * 25,)], "t string")
    assert [r["t"] for r in df.orderBy(T.time_order(F.col("t"))).collect()] == ["9", "10", "1" * 25, "b", "x", None]


def gz(path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(gzip.compress("".join(f"{x}\n" for x in lines).encode()))


def test_intake_reads_each_file_once(spark, tmp_path):
    raw, table = tmp_path / "raw", str(tmp_path / "table")
    (raw / "deep").mkdir(parents=True)
    schema = "user_id string, text string"
    take = lambda: sorted(tuple(r) for r in intake.take(spark, str(raw), table, "jsonl", schema, "*.jsonl*", 3).select("user_id", "text").collect())
    assert take() == [] and intake.rejected(spark, table, schema).count() == 0
    gz(raw / "deep" / "a.jsonl.gz", ['{"user_id": "u", "text": "one"}', "broken", "", '{"user_id": "v", "other": 1}', '{"user_id": ['])
    (raw / "ignored.txt").write_text("x\n")
    assert take() == [("u", "one"), ("v", None)]
    gz(raw / "b.jsonl.gz", ['{"user_id": "w", "text": "two"}'])
    assert take() == [("u", "one"), ("v", None), ("w", "two")] == take()
    assert sorted(r["rejected"] for r in intake.rejected(spark, table, schema).collect()) == ["broken", '{"user_id": [']
    places = intake.take(spark, str(raw), table, "jsonl", schema, "*.jsonl*").groupBy("batch").count().collect()
    assert sorted(r["count"] for r in places) == [1, 2]


def test_intake_of_csv_and_tsv(spark, tmp_path):
    gz(tmp_path / "c" / "a.csv.gz", ["user_id,text", 'u,"a ""b"", c"', "v,", "w,x,too many"])
    rows = intake.take(spark, str(tmp_path / "c"), str(tmp_path / "ct"), "csv", "user_id string, text string")
    assert sorted((r["user_id"], r["text"]) for r in rows.collect()) == [("u", 'a "b", c'), ("v", None)]
    assert [r["rejected"] for r in intake.rejected(spark, str(tmp_path / "ct"), "user_id string, text string").collect()] == ["w,x,too many"]
    gz(tmp_path / "t" / "a.tsv.gz", ["u\t2009\ta\tNone\tt\tn", "short", "1\t2\t3\t4\t5\t6\t7"])
    rows = intake.take_listens(spark, str(tmp_path / "t"), str(tmp_path / "tt")).orderBy("user_id").collect()
    assert [(r["user_id"], r["artist_id"]) for r in rows] == [("short", None), ("u", "a")]


def test_preparation_equals_a_plain_version(spark, tmp_path):
    """Raw gz files to split, texts and tables: first rows in file order, seeded users, reviews before metadata."""
    rng = random.Random(7)
    users, items = [f"u{i}" for i in range(30)], [f"i{i}" for i in range(60)]
    ratings = [(rng.choice(users), rng.choice(items), "4.0", str(rng.randrange(10**12))) for _ in range(900)]
    reviews = [(u, i, rng.choice(["", "  ", f"good {k} " * 90, f"x{k}"])) for k, (u, i, _, _) in enumerate(rng.choices(ratings, k=500))] + [("stranger", "i1", "no")]
    metadata = [{"parent_asin": i, "title": f"T{i}", "author": rng.choice([{"name": "N"}, "{'name': 'O\\'N'}", "plain"]), "description": rng.choice([["a", "b"], "['c', \"d's\"]", "text"])} for i in items[:50] + items[:5]]
    half = len(ratings) // 2
    for k, part in enumerate((ratings[:half], ratings[half:])):
        gz(tmp_path / "raw" / "ratings" / f"part{k}.csv.gz", ["user_id,parent_asin,rating,timestamp", *(",".join(r) for r in part)])
    gz(tmp_path / "raw" / "reviews" / "r.jsonl.gz", [json.dumps({"user_id": u, "parent_asin": i, "text": t, "timestamp": "1"}) for u, i, t in reviews])
    gz(tmp_path / "raw" / "metadata" / "m.jsonl.gz", map(json.dumps, metadata))
    made = prepare(spark, str(tmp_path / "raw"), str(tmp_path / "store"), 20, 28, 8)

    first, said, about = {}, {}, {}
    for u, i, _, t in ratings:
        first.setdefault(u, {}).setdefault(i, t)
    for u, i, t in reviews:
        said.setdefault((u, i), t)
    for m in metadata:
        about.setdefault(m["parent_asin"], m)
    fit = {u: x for u, x in first.items() if 20 <= len(x) <= 28}
    assert len(fit) > 8
    want = {}
    for u in random.Random(42).sample(sorted(fit), 8):
        order = sorted(fit[u], key=lambda i: (int(fit[u][i]), i))
        n_test = max(1, round(0.2 * len(order)))
        for k, i in enumerate(order):
            t = said.get((u, i), "")
            m = about.get(i)
            author = "" if m is None else {"plain": "plain"}.get(str(m["author"]), "N" if isinstance(m["author"], dict) else "O'N")
            text = "" if m is None else {"text": "text"}.get(str(m["description"]), "a b" if isinstance(m["description"], list) else "c d's")
            body = (t[:500], "review") if t.strip() else (f"{'' if m is None else m['title']} by {author}. {text}", "metadata")
            want[u, i] = ("test" if k >= len(order) - n_test else "train", *body)
    got = {(r["user_id"], r["item_id"]): (r["split"], r["embedding_input"], r["embedding_source"]) for r in made.rows.collect()}
    assert got == want
    train = collections.Counter(i for (_, i), r in want.items() if r[0] == "train")
    assert {r["item_id"] for r in made.tail.collect()} == {i for i, n in train.items() if n == 1}
    assert {r["item_id"] for r in made.items.collect()} == {i for _, i in want} and made.rejected.count() == 0
    made.write(str(tmp_path / "out"))
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "out" / "train"))
    assert back.count() == sum(r[0] == "train" for r in want.values())


def arrivals(spark, folder, rows, batches, seed):
    rng = random.Random(seed)
    rows = rows[:]
    rng.shuffle(rows)
    for k in range(batches):
        spark.createDataFrame(rows[k::batches], "user_id long, item_id long, ts timestamp").coalesce(1).write.mode("append").parquet(folder)


@pytest.mark.parametrize("seed", [1, 2])
def test_streamed_tail_in_any_order(spark, tmp_path, seed):
    import datetime as dt

    rng = random.Random(0)
    rows = [(rng.randrange(12), rng.randrange(40), dt.datetime(2024, 1, 1) + dt.timedelta(hours=k)) for k in range(90)]
    rows += [(5, 77, dt.datetime(2024, 1, 1))] * 6 + [(None, 78, dt.datetime(2024, 1, 1))]  # one user's repeats stay in the tail
    raw, folder = str(tmp_path / "raw"), str(tmp_path / "kept")

    def want(some):
        users = collections.defaultdict(set)
        for u, i, _ in some:
            if u is not None:
                users[i].add(u)
        return {i for i, x in users.items() if len(x) == 1}

    def now():
        events = spark.readStream.schema("user_id long, item_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(raw)
        return {r["item_id"] for r in tail.streamed_tail(spark, events, folder, delay="30 days").collect()}

    arrivals(spark, raw, rows[:50], 2, seed)
    assert now() == want(rows[:50])
    arrivals(spark, raw, rows[50:], 2, seed)  # the second call goes on from the first
    assert now() == want(rows)
    changes = spark.read.parquet(f"{folder}/changes")
    assert changes.groupBy("item_id").agg(F.max("version").alias("v")).where("v > 2").count() == 0
    assert changes.groupBy("item_id", "version").count().where("count > 1").count() == 0


def test_streamed_tail_forgets_old_items(spark, tmp_path):
    import datetime as dt

    raw, folder = str(tmp_path / "raw"), str(tmp_path / "kept")
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)

    def now(rows):
        spark.createDataFrame(rows, "user_id long, item_id long, ts timestamp").coalesce(1).write.mode("append").parquet(raw)
        events = spark.readStream.schema("user_id long, item_id long, ts timestamp").parquet(raw)
        return {r["item_id"] for r in tail.streamed_tail(spark, events, folder, delay="1 day", keep_days=10).collect()}

    assert now([(1, 1, day(0)), (1, 2, day(0)), (2, 2, day(0))]) == {1}
    assert now([(1, 3, day(30))]) >= {3}
    assert now([(1, 4, day(31))]) == {3, 4}  # item 1 has gone: the watermark has passed its time


def test_repeated_line_items_keep_the_order_of_the_table(spark, tmp_path):
    """Of two first lines of one order about one part, the text of the earlier row is taken, also where a later file is read first."""
    day, n = dt.datetime(2024, 1, 1), 20
    orders = spark.createDataFrame([(3 * k + 1, 1, day + dt.timedelta(days=k)) for k in range(n)], "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(k, f"part {k}", "brand", "type") for k in range(n)], "p_partkey long, p_name string, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    for number, flag, more in ((0, "A", 0), (1, "R", 5000)):  # the second file is larger
        rows = [(3 * k + 1, k, 1, flag, "O") for k in range(n)] + [(-1 - k, k, 1, flag, "O") for k in range(more)]
        made = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_linenumber int, l_returnflag string, l_linestatus string")
        made.coalesce(1).write.parquet(f"{tmp_path}/{number}")
        folder = tmp_path / "lineitem.parquet"
        folder.mkdir(exist_ok=True)
        next((tmp_path / str(number)).glob("*.parquet")).rename(folder / f"part-{number}.parquet")
    rows = queries.prepared_rows(spark, str(tmp_path)).collect()
    assert len(rows) == n and {r["embedding_input"].split(" ")[0] for r in rows} == {"A"}

"""Chat sessions in batch and as a stream, and fetching batches whole or not at all."""

import json

import pytest

from fathomline.operators.batch_fetch import fetch, reconcile, shard_states
from fathomline.operators.sessions import sessions, stream_sessions
from fathomline.sources.versions import VectorStore

COURSES = [("Deep Learning", 9, 1), ("Deep Sea", 20, 5), ("Cooking", 3, 40), ("deep", 1, 60)]
CHAT = [
    (1, 0, "/whoami"), (1, 1, "/teach x"), (1, 2, "/use SEA"), (1, 3, "/teach whales"), (1, 4, "/use nothing like it"), (1, 5, "hello"), (1, 6, "/use"), (1, 7, "/use deep"), (1, 8, "/teach"),
    (2, 0, "/teach y"), (2, 1, "/use e"), (2, 1, "/use cook"), (2, 1, "/use cook"), (2, 2, None), (None, 1, "/use cook"), (None, 2, "/teach z"), (3, 0, ""),
]


def plain(rows):
    """The same, one message after the other."""
    names = [n for n, *_ in sorted(COURSES, key=lambda c: (-c[1], c[2]))]
    held, out = {}, []
    for usr, turn, t in sorted(rows, key=lambda r: (r[0] or 0, r[1], r[2] or "")):
        said = (t or "").strip()
        if said.lower().startswith("/use") and said[4:].strip():
            low = said[4:].strip().lower()
            found = [n for n in names if n.lower() == low] or [n for n in names if low in n.lower()]
            held[usr] = found[0] if found else held.get(usr)
        out.append((usr, turn, t, held.get(usr)))
    return sorted(out, key=repr)


def told(df):
    return sorted([(r.usr, r.turn, r.t, r.course) for r in df.collect()], key=repr)


@pytest.fixture
def courses(spark):
    return spark.createDataFrame(COURSES, "course string, n long, first long")


def test_a_choice_holds_for_the_messages_that_follow(spark, courses):
    found = sessions(spark.createDataFrame(CHAT, "usr long, turn long, t string"), courses)
    assert told(found) == plain(CHAT)
    outcomes = {(r.usr, r.turn): r.outcome for r in found.collect()}
    assert [outcomes[1, k] for k in range(9)] == ["done", "choose_first", "chosen", "done", "unknown", "done", "usage", "chosen", "usage"]
    assert outcomes[3, 0] == "done" and outcomes[None, 2] == "done"


def test_one_busy_user_among_many(spark, courses):
    rows = [(7 if i % 3 else i, i, ["/use sea", "/use cook", "/use none", "hello", "/teach a"][i * i % 5]) for i in range(600)]
    assert told(sessions(spark.createDataFrame(rows, "usr long, turn long, t string").repartition(7), courses)) == plain(rows)


def test_no_messages_and_no_courses(spark, courses):
    assert sessions(spark.createDataFrame([], "usr long, turn long, t string"), courses).count() == 0
    assert {r.course for r in sessions(spark.createDataFrame(CHAT, "usr long, turn long, t string"), courses.where("n < 0")).collect()} == {None}


def test_a_stream_keeps_the_choice_between_batches(spark, courses, tmp_path):
    rows = [r for r in CHAT if r[0] is not None]
    for part in range(3):  # by turns, so that each user's choice must outlive a batch
        some = [r for r in rows if r[1] // 3 == part]
        spark.createDataFrame(some, "usr long, turn long, t string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("usr long, turn long, t string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = stream_sessions(stream, courses).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck"))
    out.trigger(availableNow=True).start().awaitTermination()
    batch = sessions(spark.createDataFrame(rows, "usr long, turn long, t string"), courses)
    as_rows = lambda df: sorted(map(tuple, df.select("usr", "turn", "t", "action", "argument", "course", "outcome").collect()), key=repr)
    assert as_rows(spark.read.parquet(str(tmp_path / "out"))) == as_rows(batch)


def answer(i, vec=None, status=200, error=None):
    return json.dumps({"custom_id": i, "error": error, "response": {"status_code": status, "body": {"data": [{"embedding": vec}]} if vec else None}})


def frames(spark, asked, lines):
    return spark.createDataFrame(asked, "custom_id string, shard long"), spark.createDataFrame([(x,) for x in lines], "value string")


def test_states_of_answers(spark):
    asked = [("a", 0), ("b", 0), ("b", 1), ("c", 1), ("d", 1), (None, 1), ("e", 2)]
    lines = [answer("a", [1.0, 0.0]), answer("a", status=429), answer("b", [3.0, 4.0]), answer("b", [0.0, 1.0]), answer("c", status=500), answer("x", [1.0, 1.0]), "", None, "{cut", answer("e", [1.0], error="late")]
    rows = {r.custom_id: r for r in reconcile(*frames(spark, asked, lines)).collect()}
    assert {k: r.state for k, r in rows.items()} == {"a": "ok", "b": "ok", "c": "failed", "d": "missing", "e": "failed", "x": "foreign", None: "unreadable"}
    assert rows["b"].vec == [0.0, 1.0] and rows["b"].shard == 0 and rows["b"].n_answers == 2
    states = {r.shard: r for r in shard_states(reconcile(*frames(spark, asked, lines))).collect()}
    assert states[0].complete and states[0].repeated == 2 and not states[1].complete and states[None].stray == 2


def test_nothing_is_published_while_a_request_is_open(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path / "store"), buckets=2)
    asked = [("a", 0), ("b", 0), ("c", 1)]
    first = [answer("a", [1.0, 0.0]), answer("b", status=429), answer("x", [1.0, 1.0])]
    done = fetch(*frames(spark, asked, first), store, ("jobs", 1))
    assert done.version is None and store.read().count() == 0
    assert sorted(r.custom_id for r in done.again.collect()) == ["b", "c"]
    whole = [*first, answer("b", [0.0, 2.0]), answer("c", [3.0, 4.0])]
    done = fetch(*frames(spark, asked, whole), store, ("jobs", 1))
    assert done.version.number == 1 and done.again.count() == 0
    assert {r.id: [round(x, 3) for x in r.vec] for r in store.read().collect()} == {"a": [1.0, 0.0], "b": [0.0, 1.0], "c": [0.6, 0.8]}
    assert fetch(*frames(spark, asked, whole), store, ("jobs", 1)).version.number == 1

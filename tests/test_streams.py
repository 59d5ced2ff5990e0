"""Session replay in batch and as a stream, sinks and chains of checkpoints."""

import random

import pytest

from folioforge.operators import sessions as op
from folioforge.session import fresh_path
from folioforge.streaming import requests
from folioforge.streaming import sessions as st
from folioforge.streaming.sinks import BatchSink, split


def brute(rows):
    out = []
    for s in sorted({r[0] for r in rows if r[0] is not None}):
        stack, ended, request, back, refused = [], False, None, 0, 0
        for _, number, stage, allows, action, value, target in sorted((r for r in rows if r[0] == s and r[1] is not None), key=lambda r: r[1]):
            if ended:
                continue
            stack.append((number, stage, allows))
            if action == "STOP":
                ended = True
            elif action == "MODIFY" and value:
                request = value
            elif action == "ROLLBACK" and target is not None:
                if 1 <= target <= len(stack) and stack[target - 1][2]:
                    back, stack = back + 1, stack[:target]
                else:
                    refused += 1
        out.append((s, ended, request, back, refused, len(stack), stack[-1][1] if stack else None, stack[-1][0] if stack else None, ",".join(str(x[0]) for x in stack)))
    return out


def made(seed=1, sessions=25, longest=40):
    rnd = random.Random(seed)
    kinds = ["ROLLBACK", "ROLLBACK", "MODIFY", "CONTINUE", "CONTINUE", "QUERY", None]
    return [
        (s, n, rnd.choice(["triage", "execution", None]), rnd.random() < 0.7, "STOP" if n > 20 and rnd.random() < 0.1 else rnd.choice(kinds), rnd.choice([f"v{n}", "", None]), rnd.choice([None, *range(10)]))
        for s in range(sessions) for n in range(rnd.randrange(1, longest))
    ]


@pytest.mark.parametrize("segment", [op.SEGMENT, 15])
def test_replay_is_brute_force(spark, segment):
    rows = made()
    df = spark.createDataFrame([*rows, (None, 1, "x", True, "STOP", None, None), (3, None, "x", True, "STOP", None, None), rows[5]], st.ROWS).repartition(3)
    want = brute(rows)
    assert sorted(map(tuple, op.replayed(df, segment).collect())) == want
    assert sum(r[3] for r in want) > 20 and sum(r[4] for r in want) > 20
    assert op.replayed(df.limit(0)).count() == 0


def files(spark, rows, parts):
    folder = fresh_path(spark, "in")
    spark.createDataFrame(rows, st.ROWS).repartition(parts).write.json(folder)
    return folder


def test_stream_is_the_batch_fold_through_failures(spark):
    """Files in no order; the first run dies after a batch's rows are written and before its
    commit, the second after the commit and before the stream's own."""
    rows = made(2, 12, 25)
    folder, mark, sink = files(spark, rows, 5), fresh_path(spark, "offsets"), BatchSink(spark, fresh_path(spark, "states"))

    def torn(states, batch):
        if batch:
            sink.stage(states, batch)
            raise RuntimeError("lost")
        sink.write(states, batch)

    def late(states, batch):
        sink.write(states, batch)
        if batch == 1:
            raise RuntimeError("lost")

    for handle in (torn, late):
        with pytest.raises(Exception, match="lost"):
            st.run(st.arriving(spark, folder, 2), sink, mark, handle=handle).awaitTermination()
    assert sink.batches() == [0, 1]
    st.run(st.arriving(spark, folder, 2), sink, mark).awaitTermination()
    assert sink.batches() == [0, 1, 2]
    assert sorted(map(tuple, st.current(sink).collect())) == brute(rows)


def test_timer_gives_up_on_missing_numbers(spark):
    rows = [(1, n, "s", True, "MODIFY", f"v{n}", None) for n in (0, 2, 3)]
    folder, mark, sink = files(spark, rows, 1), fresh_path(spark, "offsets"), BatchSink(spark, fresh_path(spark, "states"))
    go = lambda: st.run(st.arriving(spark, folder, 1), sink, mark, st.Sessions(idle_ms=1)).awaitTermination()
    go()
    assert [(r.request, r.checkpoints) for r in st.current(sink).collect()] == [("v0", 1)]
    assert [r.waiting for r in sink.read(st.OUT).collect()] == [2]
    spark.createDataFrame([(2, 0, "s", True, None, None, None)], st.ROWS).write.mode("append").json(folder)
    go()
    assert {r.session_id: (r.request, r.checkpoints) for r in st.current(sink).collect()} == {1: ("v3", 3), 2: (None, 1)}


def test_split_sinks_take_a_batch_once(spark):
    a, b = (BatchSink(spark, fresh_path(spark, n)) for n in ("done", "pending"))
    handle = split({"done": ("status = 'ok'", a), "pending": ("status <> 'ok'", b)})
    rows = spark.createDataFrame([(1, "ok"), (2, "open"), (3, "ok")], "id long, status string")
    a.write(rows.where("status = 'ok'"), 0)  # the first sink had it before a failure
    handle(rows, 0)
    handle(rows, 0)
    assert sorted(r.id for r in a.read(rows.schema).collect()) == [1, 3] and [r.id for r in b.read(rows.schema).collect()] == [2]
    assert BatchSink(spark, fresh_path(spark, "none")).read(rows.schema).count() == 0


def test_packed_requests(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows = [("a.txt", "summarize this "), ("B.TXT", "x" * 2001), (".hidden.txt", "no"), ("~t.txt", "no"), ("c.md", "no"), ("e.txt", " \n"), (None, "no"), ("n.txt", None)]
    spark.createDataFrame(rows, "name string, request string").coalesce(1).write.json(folder)
    sink = BatchSink(spark, str(tmp_path / "out"))
    stream = requests.triaged(requests.packed(spark, folder))
    requests.run(stream, sink.write, str(tmp_path / "marks")).awaitTermination()
    assert {r.name: (len(r.request), r.category) for r in sink.read(stream.schema).collect()} == {"a.txt": (14, "summarization"), "B.TXT": (2014, "sysadmin")}


def test_long_chains(spark):
    rows = [(s, f"c{i}", f"c{i - 1}" if i else None) for s, n in ((1, 1000), (2, 1), (3, 37)) for i in range(n)] + [(4, "x", "gone"), (4, "y", "x")]
    got = op.depths(spark.createDataFrame(rows, "session_id long, checkpoint_id string, parent_id string").repartition(3)).collect()
    assert sorted((r.session_id, r.checkpoint_id, r.depth) for r in got) == sorted([(s, c, int(c[1:])) for s, c, _ in rows if s < 4] + [(4, "x", 0), (4, "y", 1)])

import hashlib
import random

from pyspark.sql import types as T

from pulse.llm import chat
from pulse.llm.common import read_table

SF = "/root/testdata/sf0.001"
LOG = "conv_id long, seq long, event string, turn long, role string, text string"


def brute(events):
    """Replay in sequence: the whole conversation in memory."""
    messages = {}
    for _, event, turn, role, text in sorted(events):
        if event == "start":
            messages[turn] = [role, text]
        elif event == "delete":
            messages.pop(turn, None)
        else:
            m = messages.setdefault(turn, [role or "assistant", ""])
            m[1] = m[1] + text if event == "delta" else text
            if event == "regenerate":
                messages = {t: m for t, m in messages.items() if t <= turn}
    return [tuple(messages[t]) for t in sorted(messages)]


def sha(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def test_escape_is_reversible_and_leaves_no_control():
    rng = random.Random(2)
    bits = [*chat.CONTROLS, "<", "|", "\\", "s>", "/", "[", "INST]", "<<", "SYS>>", "a", "<|im_end|>\n"]
    for _ in range(3000):
        text = "".join(rng.choices(bits, k=rng.randint(0, 9)))
        assert chat.unescape(chat.escape(text)) == text
        assert not any(c in chat.escape(text) for c in chat.CONTROLS)
        role = rng.choice(["assistant", "user", text])
        segment, a, b = chat.render(role, text)
        assert chat.read_segment(segment) == (role, text)
        assert (a is None) == (role != "assistant") and (a is None or chat.unescape(segment[a:b]) == text)


def test_fold_against_replay(spark):
    rng, logs = random.Random(4), {}
    for conv in range(60):
        events, started = [], []
        for seq in range(rng.randint(1, 40)):
            turn = len(started)
            if not started or rng.random() < 0.3:
                events.append((seq, "start", turn, rng.choice(["user", "assistant", "system"]), rng.choice(["", "hi ", "[INST]"])))
                started.append(turn)
            else:
                turn = rng.choice(started)
                events.append((seq, rng.choice(["delta"] * 5 + ["edit", "regenerate", "delete"]), turn, "", f"t{seq} "))
        logs[conv] = events
    rows = [(c, *e) for c, events in logs.items() for e in events]
    rng.shuffle(rows)
    got = {}
    for r in chat.segments(spark.createDataFrame(rows, LOG)).collect():
        got.setdefault(r.conv_id, []).append((r.position, *chat.read_segment(r.segment)))
    for conv, events in logs.items():
        # a message that comes back after its start was voided has lost its role
        want = brute(events)
        have = [m[1:] for m in sorted(got.get(conv, []))]
        assert have == want, (conv, events)


def test_conversations(spark):
    rows = [tuple(r) for r in read_table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    by = {}
    for c, turn, role, text in sorted(rows, key=lambda r: (r[0], r[1])):
        by.setdefault(c, []).append((role, text or ""))
    got = {r.conv_id: r for r in chat.op9_chat(spark, SF).collect()}
    assert got.keys() == by.keys()
    for c, turns in by.items():
        trained = [t for role, t in turns if role == "assistant"]
        assert tuple(got[c])[1:5] == (len(turns), sha(f"{r}\n{t}\n" for r, t in turns), sum(map(len, trained)), sha(trained))
        assert got[c].formatted_chars == sum(len(chat.render(r, t)[0]) for r, t in turns)


def test_nulls_ties_repeats_long_texts_and_clashing_names(spark):
    schema = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
                           *(T.StructField(n, T.StringType()) for n in ("role", "text", "seq", "segment"))])
    long = "x é " * 100_000
    rows = [(1, 0, None, None), (1, None, "user", "first"), (1, 2, "user", "b"), (1, 2, "user", "a"), (1, 2, "user", "a"),
            (None, 0, "assistant", "z"), (2, 0, "assistant", long)]
    turns = spark.createDataFrame([(*r, "s", "s") for r in rows], schema)
    got = {}
    for r in chat.segments(chat.log_of(turns)).orderBy("position").collect():
        got.setdefault(r.conv_id, []).append(chat.read_segment(r.segment))
    assert got == {1: [("user", "first"), ("", ""), ("user", "a"), ("user", "a"), ("user", "b")], None: [("assistant", "z")],
                   2: [("assistant", long)]}
    assert {r.conv_id: r.n_turns for r in chat.digests(chat.segments(chat.log_of(turns))).collect()} == {1: 5, None: 1, 2: 1}
    assert chat.segments(chat.log_of(spark.createDataFrame([], schema))).collect() == []


def test_the_log_of_finished_turns_is_streamed(spark):
    turns = [(1, 0, "user", "a😀\n" * 100), (1, 1, "assistant", "x" * 130), (1, 1, "assistant", "w" * 70), (1, 1, "assistant", "w" * 70),
             (1, 2, None, None), (2, None, "user", "é" * 64)]
    log = chat.log_of(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    by = {}
    for r in log.collect():
        by.setdefault(r.conv_id, []).append(r)
    texts = {}
    for conv, events in by.items():
        events.sort(key=lambda r: r.seq)
        assert [r.seq for r in events] == list(range(len(events)))
        for r in events:
            if r.event == "start":
                texts.setdefault(conv, []).append((r.turn, r.role, r.text))
            else:
                assert r.event == "delta" and 0 < len(r.text) <= chat.DELTA_CHARS
                turn, role, text = texts[conv][-1]
                assert (r.turn, r.role) == (turn, role)
                texts[conv][-1] = (turn, role, text + r.text)
    want = {1: [(0, "user", "a😀\n" * 100), (1, "assistant", "w" * 70), (1, "assistant", "w" * 70), (1, "assistant", "x" * 130), (2, "", "")],
            2: [(None, "user", "é" * 64)]}
    assert texts == want and sum(r.event == "delta" for events in by.values() for r in events) == 5 + 2 + 2 + 3 + 1
    got = {}
    for r in chat.segments(log).collect():
        got.setdefault(r.conv_id, []).append((r.position, chat.read_segment(r.segment)))
    assert {c: [m for _, m in sorted(ms)] for c, ms in got.items()} == {c: [m[1:] for m in ms] for c, ms in want.items()}

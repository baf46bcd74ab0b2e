import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import conversation_repair, role_grammar
from ledgerloom.llm.conversation_repair import damaged, repair, repaired_turns
from ledgerloom.llm.queries import QUERIES
from tests.conftest import DATA

SOUND = re.compile(r"(s?(ua)+)?")
FIGURES = conversation_repair.FIGURES


def _faults(rows):
    """The first fault of each row (turn, role, text), in order."""
    seen, out = set(), []
    for _, role, text in rows:
        left = text.strip(" \t\n\x0b\x0c\r")
        if not left:
            out.append(1)
        elif (role, text) in seen:
            out.append(2)
        else:
            out.append(0 if left[-1] in ".!?" else 3)
        seen.add((role, text))
    return out


def _ordered(rows):
    digest = lambda text: hashlib.md5(text.encode()).digest()
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], digest(r[2])))


def _cheapest_by_dynamic_programming(rows, faults):
    """Least (cost, audit, repaired lines) by what has been written so far: nothing, an s, a u or an a."""
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    names = {"u": "user", "a": "assistant"}
    best = {"": (0, "", ())}

    def inserted(best):
        for _ in range(4):
            for state, (cost, audit, lines) in list(best.items()):
                for initial, name in names.items():
                    to = after.get((state, initial))
                    way = (cost + 3, audit + "I", (*lines, f"{name}:"))
                    if to and (to not in best or way[:2] < best[to][:2]):
                        best[to] = way
        return best

    for (_, role, text), fault in zip(rows, faults):
        new = {}
        for state, (cost, audit, lines) in inserted(best).items():
            ways = [(state, (cost + 4, audit + "D", lines))]
            if fault not in (1, 2):
                extra = 3 if fault == 3 else 0
                edits = [(role[:1], role, "K", 0), *[(i, n, "R", 3) for i, n in names.items()]]
                for initial, name, edit, price in edits:
                    to = after.get((state, initial))
                    ways.append((to, (cost + price + extra, audit + edit, (*lines, f"{name}:{text}"))))
            for to, way in ways:
                if to is not None and (to not in new or way[:2] < new[to][:2]):
                    new[to] = way
        best = new
    return min((way for state, way in inserted(best).items() if state in ("", "a")), key=lambda w: w[:2])


def _expected(conversations):
    out = {}
    for conv_id, rows in conversations.items():
        rows = _ordered(rows)
        faults = _faults(rows)
        numbers = [t for t, _, _ in rows if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
        cost, audit, lines = _cheapest_by_dynamic_programming(rows, faults)
        out[conv_id] = (
            gaps, *[faults.count(f) for f in (1, 2, 3)], sum(p not in ("su", "ua", "au") for p in pairs),
            cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def _got(result):
    return {r.conv_id: (*[r[c] for c in FIGURES], r.audit, r.repaired_sha256) for r in result.collect()}


def _damage(rows):
    """The rows that `damaged` gives, by its words."""
    out = defaultdict(list)
    for conv_id, turn, role, text in rows:
        name = ":".join(" " if x is None else str(x) for x in (conv_id, turn))
        fate = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        out[conv_id] += []
        if fate == 0:
            continue
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(fate, text)
        role = "user" if fate == 4 else role
        out[conv_id] += [(turn, role, text)] * (2 if fate == 3 else 1)
    return out


def test_query_equals_definition(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").collect()]
    got = _got(QUERIES["op13_conversation_repair"](spark, DATA))
    assert got == _expected(_damage(rows))
    assert len({len(set(x[6])) for x in got.values()}) > 1


def _all_repairs(turns):
    """Every sequence of edits with at most two inserts between turns: least (cost, audit)."""
    best = None
    options = []
    for initial, fault in turns:
        extra = 3 if fault == 3 else 0
        ways = [("D", "", 4)]
        if fault not in (1, 2):
            ways += [("K", initial, extra), ("R", "u", 3 + extra), ("R", "a", 3 + extra)]
        options.append(ways)
    inserts = ["", "u", "a", "ua", "au"]
    for ways in itertools.product(*options):
        for put in itertools.product(inserts, repeat=len(turns) + 1):
            word = put[0] + "".join(w[1] + p for w, p in zip(ways, put[1:]))
            if SOUND.fullmatch(word):
                cost = 3 * sum(map(len, put)) + sum(w[2] for w in ways)
                audit = "I" * len(put[0]) + "".join(w[0] + "I" * len(p) for w, p in zip(ways, put[1:]))
                best = min(best, (cost, audit)) if best else (cost, audit)
    return best


def test_parser_equals_all_repairs():
    kinds = [("s", 0), ("u", 0), ("a", 0), ("x", 0), ("u", 3), ("a", 3), ("u", 2), ("", 1)]
    cases = [turns for n in range(4) for turns in itertools.product(kinds, repeat=n)]
    for turns in random.Random(3).sample(cases, 250):
        cost, audits = role_grammar.cheapest([role_grammar.table(turns, role_grammar.ENTRIES)])
        assert (cost, "".join(audits)) == _all_repairs(turns), turns


def test_tables_cut_anywhere_give_the_same():
    rng = random.Random(8)
    for _ in range(40):
        turns = [(rng.choice("suuaaax"), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(30)]
        whole = role_grammar.cheapest([role_grammar.table(turns, [0])])
        cuts = sorted(rng.sample(range(31), 4))
        parts = [turns[a:b] for a, b in zip([0, *cuts], [*cuts, 30])]
        cost, audits = role_grammar.cheapest([role_grammar.table(p, role_grammar.ENTRIES) for p in parts])
        assert (cost, "".join(audits)) == (whole[0], "".join(whole[1]))


def test_grammar_accepts_what_the_pattern_does():
    for n in range(8):
        for word in map("".join, itertools.product("sua", repeat=n)):
            stack = role_grammar.EMPTY
            for terminal in word:
                stack = stack and role_grammar.shifted(stack, terminal)
            accepted = bool(stack and role_grammar.shifted(stack, role_grammar.END))
            assert accepted == bool(SOUND.fullmatch(word))


def _made_up(seed, n, turns):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "cut off", "", " ", "Why?", *[f"Text {i}." for i in range(200)]]
    return {
        c: [
            (rng.choice([None, t, t, t, t + 1]), rng.choice(["user", "assistant", "system", "tool", ""]), rng.choice(texts))
            for t in range(rng.randint(1, turns))
        ]
        for c in range(n)
    }


def _frame(spark, conversations):
    rows = [(c, *r) for c, turns in conversations.items() for r in turns]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)


def test_long_conversation_over_many_tasks(spark, monkeypatch, conf):
    conversations = _made_up(5, 20, 12)
    conversations[7] = _made_up(6, 1, 3000)[0] + [(5, "user", "Yes.")] * 700
    conf(adaptive__coalescePartitions__enabled="false", shuffle__partitions="7")
    frame = _frame(spark, conversations)
    assert _got(repair(frame)) == _expected(conversations)


@pytest.mark.parametrize("whole", [1, 3])
def test_small_pieces(monkeypatch, whole):
    """The parser of one task, without Spark, with pieces of three turns."""
    import pyarrow as pa

    monkeypatch.setattr(conversation_repair, "PIECE_TURNS", 3)
    monkeypatch.setattr(conversation_repair, "WHOLE_PIECES", whole)
    conversations = {c: _ordered(rows) for c, rows in _made_up(11, 15, 25).items()}
    rows = [(c, *r, f) for c, turns in conversations.items() for r, f in zip(turns, _faults(turns))]
    names = ["conv_id", "turn", "role", "text", "fault"]
    columns = dict(zip(names, zip(*rows)))
    table = pa.table({c: pa.array(v, pa.int64() if c in ("conv_id", "turn", "fault") else pa.string()) for c, v in columns.items()})

    class Task:
        partitionId = staticmethod(lambda: 0)

    monkeypatch.setattr(conversation_repair.TaskContext, "get", lambda: Task)
    out = [r for b in conversation_repair._parse(table.to_batches(max_chunksize=4), False) for r in b.to_pylist()]
    done = {r["conv_id"]: (*[r[c] for c in FIGURES], r["audit"], r["repaired_sha256"]) for r in out if r["task"] is None}
    pieces = sorted((r for r in out if r["task"] is not None), key=lambda r: (r["conv_id"], r["piece"]))
    halves = [(r["conv_id"], body, r["task"], r["piece"], r["body" if body else "summary"]) for r in pieces for body in (False, True)]
    halves.sort(key=lambda r: r[:4])
    batch = pa.table(dict(zip(["conv_id", "is_body", "task", "piece", "data"], map(list, zip(*halves)))))
    for b in conversation_repair._join_pieces(batch.to_batches(max_chunksize=5), False):
        for r in b.to_pylist():
            done[r["conv_id"]] = (*[r[c] for c in FIGURES], r["audit"], r["repaired_sha256"])
    assert done == _expected(conversations)


def test_repaired_turns_are_sound(spark):
    conversations = _made_up(3, 60, 10)
    rows = repaired_turns(_frame(spark, conversations)).collect()
    digests = {c: x[7] for c, x in _expected(conversations).items()}
    by_id = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.conv_id, r.place)):
        assert r.place == len(by_id[r.conv_id])
        by_id[r.conv_id].append(r)
    for c, turns in by_id.items():
        assert SOUND.fullmatch("".join(t.role[:1] for t in turns))
        assert hashlib.sha256("\n".join(f"{t.role}:{t.text}" for t in turns).encode()).hexdigest() == digests[c]


def test_odd_rows(spark):
    rows = [
        (1, None, None, None), (None, 1, "user", "Hi."), (None, 1, "user", "Hi."), (None, None, "assistant", "Hm"),
        (2, 0, "system", "x" * 100_000 + "."), (2, 3, "user", "ünï 漢?"), (3, 0, "", "a.\x0b"), (4, 2, "user", " "),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    extra = frame.withColumns({c: F.lit("x") for c in ("fault", "task", "place", "_salt", "_digest", "asked", "copy")})
    assert _got(repair(extra)) == _expected(
        {c: [(t, r if r is not None else " ", x if x is not None else " ") for i, t, r, x in rows if i == c]
         for c in (1, None, 2, 3, 4)}
    )
    dropped = next(n for n in range(100) if zlib.crc32(f"{n}:0".encode()) % 20 == 0)
    one = spark.createDataFrame([(dropped, 0, "user", "Hi.")], frame.schema)
    result = conversation_repair.with_all_conversations(repair(damaged(one)), one)
    assert _got(result) == {dropped: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert repair(frame.limit(0)).collect() == [] and repaired_turns(frame.limit(0)).collect() == []
    by_name = repair(frame.withColumn("conv_id", F.concat(F.lit("c"), "conv_id")))
    assert {r.conv_id for r in by_name.collect()} == {"c1", "c2", "c3", "c4", None}

"""op12: repaired conversations against an exhaustive search and against the query's digests."""

import hashlib
import re
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import functions as F

from kontingent.llm import queries, turnrepair as tr

GRAMMAR = re.compile(r"(s?(ua)+)?$")


def faults(rows):
    out, seen = [], set()
    for role, text in rows:
        last = text.rstrip(" \t\n\v\f\r")[-1:]
        f = "blank" if not last else "duplicate" if (role, text) in seen else None if last in ".!?" else "truncated"
        seen.add((role, text))
        out.append(f)
    return out


def brute(rows):
    """(cost, audit, repaired) by trying every way: a search over (rows read, initials written so far), whole strings compared."""
    bad = faults(rows)

    def fits(initials):
        return re.match(r"s?(ua)*u?$", initials)

    @lru_cache(None)
    def ways(k, initials):
        """Least (cost, audit, roles) of the rest, or None."""
        found = []
        if k == len(rows) and GRAMMAR.match(initials):
            found.append((0, "", ()))
        moves = [("I", 5, r, k) for r in ("user", "assistant")] if len(initials) < 2 * len(rows) + 3 else []
        if k < len(rows):
            moves.append(("D", 2, None, k + 1))
            if bad[k] in (None, "truncated"):
                more = 5 if bad[k] else 0
                moves += [("R", 1 + more, r, k + 1) for r in ("user", "assistant")]
                if rows[k][0]:
                    moves.append(("K", more, rows[k][0], k + 1))
        for letter, cost, role, at in moves:
            now = initials + (role[0] if role else "")
            if role is None or fits(now):
                rest = ways(at, now)
                if rest:
                    found.append((cost + rest[0], letter + rest[1], (role, *rest[2])))
        return min(found, key=lambda x: x[:2]) if found else None

    cost, audit, roles = ways(0, "")
    out, at = [], 0
    for letter, role in zip(audit, roles):
        if letter != "D":
            out.append(f"{role}:" + ("" if letter == "I" else rows[at][1]))
        at += letter != "I"
    return cost, audit, out


def conversation(rng, n):
    # few texts, so that there are duplicates, blanks and cut texts
    texts = ["yes.", "no.", "cut", "  ", "", "ok!", "so? ", "x,", "a.b"] + [f"t{k}." for k in range(12)]
    return [(str(rng.choice(["user", "assistant", "system", "user", "assistant", "tool", ""])), str(rng.choice(texts))) for _ in range(n)]


def log_of(rows, conv=7):
    r, out = tr.Repair(conv), []
    for k, (role, text) in enumerate(rows):
        out += r.add(k, role, text)
    return out + r.end()


def test_against_exhaustive_search(monkeypatch):
    rng = np.random.default_rng(5)
    for trial in range(400):
        rows = conversation(rng, int(rng.integers(0, 8)))
        want = brute(rows)
        for open_rows in (1, 3, 16):  # settled at once, now and then, or only at the end
            monkeypatch.setattr(tr, "OPEN", open_rows)
            log = log_of(rows)
            edits = "".join(x[2] or "" for x in log)
            got = sum(x[8] for x in log), edits, [f"{x[4]}:{x[5]}" for x in log if x[2] not in ("D", None)]
            assert got == want, rows
            assert [x[6] for x in log if x[2] not in ("I", None)] == faults(rows)


def test_long_conversation_is_settled_as_it_goes(monkeypatch):
    rng = np.random.default_rng(6)
    rows = [r for k in range(4000) for r in (("user", f"q{k}."), ("assistant", f"a{k}."))]
    rows = [rows[k] if rng.random() > 0.1 else (("tool", "z") if rng.random() < 0.5 else rows[k - 1]) for k in range(len(rows))]
    r, open_rows, out = tr.Repair(1), 0, []
    for k, (role, text) in enumerate(rows):
        out += r.add(k, role, text)
        open_rows = max(open_rows, len(r.open))
    out += r.end()
    assert open_rows <= 3 * tr.OPEN and len({x[1] for x in out}) == len(out)
    monkeypatch.setattr(tr, "OPEN", 1 << 30)
    assert log_of(rows, 1) == out


def expected(rows):
    """The query's rows by plain loops."""
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, [])
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out[conv] += [(turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    result = {}
    for conv, own in out.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        plain = [r[1:] for r in own]
        turns = {r[0] for r in own} - {None}
        bad = faults(plain)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(plain, plain[1:]))
        cost, audit, said = brute(plain)
        result[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[bad.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return result


def test_query_on_odd_rows(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = []
    for conv in [None, *range(60)]:
        for role, text in conversation(rng, int(rng.integers(1, 7))):
            rows.append((conv, None if rng.random() < 0.15 else int(rng.integers(-2, 6)), None if role == "" else role, None if text == "" else text))
    rows += rows[:5]
    spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, edit string, cost int").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: tuple(r)[1:] for r in queries.QUERIES["op12_conversation_repair"](spark, str(tmp_path)).collect()}
    assert got == expected(rows)


def test_repaired_conversations_and_empty_table(spark):
    long = "word " * 300_000 + "."
    rows = [(1, 0, "assistant", "hi."), (1, 1, "user", long), (1, 2, "assistant", "well."), (2, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    log = tr.repair(df)
    kept = [(r["role"], len(r["text"])) for r in log.where("conv_id = 1 and edit <> 'D'").orderBy("place").collect()]
    assert kept == [("user", len(long)), ("assistant", 5)]
    assert [tuple(r) for r in log.where("conv_id = 2").select("edit", "role", "fault", "cost").collect()] == [("D", " ", "blank", 2)]
    assert tr.repair(df, alive=F.col("conv_id") == 1).where("conv_id = 2").first()["edit"] is None
    assert tr.repair(df.limit(0)).count() == 0

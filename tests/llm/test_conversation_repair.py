import random
import zlib
from functools import lru_cache
from hashlib import sha256

import pytest

from dwellspark.llm import conversation_repair as R
from dwellspark.llm.queries import op11_conversation_repair

BLANK = " \t\n\x0b\f\r"
SCHEMA = "conv_id bigint, turn bigint, role string, text string, block int, cost string"


def damaged(rows):
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fate = zlib.crc32(key.encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if fate == 1 else text.translate(str.maketrans("", "", ".!?")) if fate == 2 else text
        for _ in range(0 if fate == 0 else 2 if fate == 3 else 1):
            yield conv, turn, "user" if fate == 4 else role, text


def best(rows):
    """Edits by trying all of them from each place, remembering the best of what follows; (initial, fault) rows."""

    @lru_cache(None)
    def after(i, have, inserts):
        options = [(0, "")] if i == len(rows) and have in ("", "a") else []
        need = "a" if have == "u" else "u"
        if inserts < 3:
            cost, edits = after(i, need, inserts + 1)
            options.append((cost + 2, "I" + edits))
        if i < len(rows):
            initial, fault = rows[i]
            cost, edits = after(i + 1, have, 0)
            options.append((cost + 3, "D" + edits))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                for edit, now in [("K", initial)] * (initial == need or (have == "" and initial == "s")) + [("R", need)]:
                    cost, edits = after(i + 1, now, 0)
                    options.append((cost + more + 2 * (edit == "R"), edit + edits))
        return min(options, default=(10**9, ""))

    for i in range(len(rows), 0, -1):  # from the end, so that no call goes deep
        for have in ("", "s", "u", "a"):
            after(i, have, 0)
    return after(0, "", 0)


def brute(original, rows):
    out = {}
    for conv in {r[0] for r in original}:
        own = [r[1:] for r in rows if r[0] == conv]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = {t for t, _, _ in own if t is not None}
        faults, seen = [], set()
        for _, role, text in own:
            inside = text.strip(BLANK)
            faults.append("blank" if not inside else "duplicate" if (role, text) in seen else "truncated" if inside[-1] not in ".!?" else "")
            seen.add((role, text))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit = best([(role[:1], fault) for (_, role, _), fault in zip(own, faults)])
        left, at, have = [], 0, ""
        for edit in audit:
            need = "assistant" if have == "u" else "user"
            if edit == "I":
                left.append(f"{need}:")
            else:
                _, role, text = own[at]
                at += 1
                if edit == "D":
                    continue
                left.append(f"{need if edit == 'R' else role}:{text}")
            have = left[-1][0]
        out[conv] = (
            conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
            illegal, cost, audit, sha256("\n".join(left).encode()).hexdigest(),
        )
    return sorted(out.values(), key=repr)


def table(spark, rows):
    return spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA).repartition(3)


def report(spark, rows, **options):
    whole = table(spark, rows)
    return sorted(map(tuple, R.repair_report(whole, R.damage(whole), **options).collect()), key=repr)


def made(seed, conversations=40, longest=12):
    rng = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "User", "", None, "u"], ["Yes.", "No!", "cut", " \t", "", None, "Why?", "é", "stop. "]
    rows = []
    for conv in range(conversations):
        for turn in range(rng.randrange(1, longest)):
            usual = ["user", "assistant"][turn % 2]
            role = usual if rng.random() < 0.7 else rng.choice(roles)
            text = f"{turn} said." if rng.random() < 0.5 else rng.choice(texts)
            rows.append((conv, rng.choice([turn, turn, turn, 2 * turn + 3, None]) if conv % 4 == 0 else turn, role, text))
    return [r for k, r in enumerate(rows) if r[1] is not None or (r[0], None) not in {(x[0], x[1]) for x in rows[:k]}]


@pytest.mark.parametrize("block_rows", [1, 3, 4096])
def test_equals_all_edits_in_blocks_of_any_size(spark, block_rows):
    rows = [r for k, r in enumerate(made(1)) if (r[0], r[1]) not in {(x[0], x[1]) for x in made(1)[:k]}]
    assert report(spark, rows, block_rows=block_rows) == brute(rows, list(damaged(rows)))


def test_odd_rows(spark):
    rows = [(None, 0, "user", "Hi."), (None, 1, "assistant", "Ho."), (1, None, None, None), (2, 5, "user", "long " * 50_000 + "."), (2, 6, "assistant", "Yes.")]
    rows += [(3, 0, "user", "Same.")] * 4 + [(4, -3, "system", "Be."), (4, 10**12, "user", "x\n\ny?")]
    assert report(spark, rows) == brute(rows, list(damaged(rows)))
    dropped = [(c, 0, "user", "Hi.") for c in range(60) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    got = report(spark, dropped)
    assert got == [(r[0], 0, 0, 0, 0, 0, 0, "", sha256().hexdigest()) for r in dropped] and got
    assert R.repair_report(table(spark, rows).limit(0), table(spark, rows).limit(0)).count() == 0


def test_a_conversation_over_many_tasks_and_blocks(spark):
    rng = random.Random(5)
    rows = [(8, t, rng.choice(["user", "assistant"]), rng.choice(["Well.", f"{t}.", "so", ""])) for t in range(3000)] + [(7, 0, "user", "A?"), (9, 0, "user", "B?")]
    got = {r[0]: r for r in report(spark, rows, block_rows=50)}
    assert sorted(got.values(), key=repr) == brute(rows, list(damaged(rows)))
    edits, _ = R.repair(R.damage(table(spark, rows)), block_rows=50)
    long = edits.filter("conv_id = 8").orderBy("block", "step").collect()
    assert "".join(e.edit for e in long) == got[8][7] and sum(e.cost for e in long) == got[8][6]
    left = "".join(e.role[0] for e in long if e.edit != "D")
    assert left == "ua" * (len(left) // 2) and len({e.block for e in long}) > 50


def test_vectors_between_checkpoints(spark):
    rng = random.Random(2)
    for n in (0, 1, 2, 5, 30, 200):
        codes = bytes(rng.choice([0, 1, 2, 3, 4, 9, 10, 11]) for _ in range(n))
        m = R.matrix(codes)
        costs = R.END
        for code in reversed(codes):
            costs = R._sooner(code, costs)
        if n:
            assert costs == tuple(min(m[4 * x + to] + R.END[to] for to in range(4)) for x in range(4))
        (audit,), _ = R.walk(codes, R.END, [R.START], True)
        rows = [(" sua"[c & 3], {0: "", 4: "blank", 8: "truncated"}[c & 12]) for c in codes]
        assert best(rows) == (costs[0], audit)


def test_query_equals_brute_force(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted(map(tuple, op11_conversation_repair(spark, folder).collect()), key=repr)
    assert got == brute(rows, list(damaged(rows))) and {r[7] for r in got} - {""}

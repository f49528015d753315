import heapq
import random
import re
import zlib
from hashlib import sha256

from catchwater.llm import conversations, queries

SCHEMA = "conv_id long, turn long, role string, text string"


def least_edits(rows):
    """(cost, audit, repaired) by a search over whole edit strings, cheapest first and then least; rows: (role, text, forced, late)."""
    after = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}
    kept = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
    queue, seen = [(0, "", 0, 0, ())], set()
    while queue:
        cost, audit, k, q, out = heapq.heappop(queue)
        if (k, q) in seen:
            continue
        seen.add((k, q))
        if k == len(rows) and q in (0, 3):
            return cost, audit, "\n".join(out)
        to, name = after[q]
        heapq.heappush(queue, (cost + 3, audit + "I", k, to, (*out, f"{name}:")))
        if k < len(rows):
            role, text, forced, late = rows[k]
            heapq.heappush(queue, (cost + 4, audit + "D", k + 1, q, out))
            if not forced:
                heapq.heappush(queue, (cost + 3 + 3 * late, audit + "R", k + 1, to, (*out, f"{name}:{text}")))
                if (role[:1], q) in kept:
                    heapq.heappush(queue, (cost + 3 * late, audit + "K", k + 1, kept[role[:1], q], (*out, f"{role}:{text}")))


def wanted(turns, damage=True):
    out = {}
    for conv, turn, role, text in turns:
        group = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        group += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    found = {}
    for conv, group in out.items():
        group.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, rows, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in group:
            said = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not said else "duplicate" if (role, text) in seen else "" if said[-1] in ".!?" else "truncated"
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            rows.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        cost, audit, repaired = least_edits(rows)
        numbers = [t for t, _, _ in group if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        found[conv] = (gaps, *counts.values(), illegal, cost, audit, sha256(repaired.encode()).hexdigest())
    return found


def got(df):
    out = {}
    for r in df.collect():
        assert r["conv_id"] not in out
        out[r["conv_id"]] = tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"))
    return out


def turns(seed, n, longest=9, ties=3):
    """Turns whose ties differ by role, so that their order needs no hash; with ties=2 there are none."""
    r, rows = random.Random(seed), []
    for conv in range(n):
        for turn in range(r.randrange(1, longest)):
            role = r.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None, "u", "api"])
            rows.append((conv, turn * r.choice([1, 1, 1, 2]), role, r.choice(["Hello.", "hello", " \n", "", None, "What? ", "é 日本!\t", "a" * 40 + ".", f"{turn}."])))
    keys = {}
    for row in rows:
        keys.setdefault(row[:ties], row)
    return list(keys.values())


def test_edits_are_least_and_first(spark):
    rows = turns(1, 120) + [(None, 1, "user", "x."), (None, None, "assistant", "y"), (None, 2, "assistant", "z!"), (500, None, None, None)]
    clash = [(*r, "a", 1, True) for r in rows]
    df = spark.createDataFrame(clash, SCHEMA + ", audit string, n int, present boolean")
    assert got(conversations.repaired(df)) == wanted(rows, damage=False)
    assert conversations.repaired(df.limit(0)).count() == 0


def test_small_chunks_give_the_same(spark):
    """One conversation with a third of all rows over many chunks and partitions; long texts; copies of rows."""
    rows = turns(2, 40) + [(7000, t, random.Random(t).choice(["user", "assistant", "system"]), f"{t % 50} said{random.Random(-t).choice('.x')}") for t in range(300)]
    rows += [(7001, 5, "user", "again.")] * 40 + [(7001, 6, "assistant", "so." * 4000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = wanted(rows, damage=False)
    assert got(conversations.repaired(df, rows=7)) == want
    assert got(conversations.repaired(df, rows=1)) == want
    assert got(conversations.repaired(df, size=60)) == want


def test_the_query(spark, tmp_path):
    rows = turns(3, 200, ties=2) + [(9000 + k, 0, "user", "One. Two!") for k in range(60)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    found, want = got(queries.op11_conversation_repair(spark, str(tmp_path))), wanted(rows)
    assert found == want
    none = sha256(b"").hexdigest()
    assert (0, 0, 0, 0, 0, 0, "", none) in found.values()  # all rows dropped


def test_distances_are_shortest():
    r = random.Random(5)
    for _ in range(60):
        rows = [(r.choice("suax"), r.random() < 0.3) for _ in range(r.randrange(7))]
        dist = conversations.distances(rows, conversations.GOAL)
        best = least_edits([(i, "t", False, late) for i, late in rows])
        assert dist[0] == best[0]
        letters, end = conversations.walked(rows, dist, 0)
        assert "".join(letters) + {0: "", 1: "II", 2: "I", 3: ""}[end] == best[1]

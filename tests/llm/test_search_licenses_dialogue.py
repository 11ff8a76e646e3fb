"""Lexical search, license scans and conversation repair against plain versions, on awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from strandforge.llm import dialogue, lexical, licenses, queries

DOCS = "doc_id long, text string, lang string, term string, block int, ids string, _item int"


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    words = ["The", "red", "fox", "été", "Ünder", "x1", "common", "common", "common", "l" * 50, "a\x00b", "日本"]
    out = [(None, "common red"), (None, None), (1, None), (2, ""), (3, " .,;\n"), (4, "common"), (5, "common"), (6, "COMMON"), (6, "common"), (6, "common")]
    out += [(i, " ".join(r.choice(words) for _ in range(r.randint(1, 40)))) for i in range(7, 120)]
    return out + [(200, "fox " * 60000 + "red"), (201, "word" + "ß" * 3_000_000)]


def ranked(docs, items, k):
    held = []
    for i, t in docs:
        c = Counter(re.findall(lexical.TERM, lowered(t)))
        if c:
            held.append((i, c, sum(c.values())))
    n, total = len(held), sum(x[2] for x in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in set(items):
        q = Counter(re.findall(lexical.TERM, lowered(text)))
        scores = []
        for i, c, size in held:
            m = 100 - 25 + (25 * size * n) // total
            s = sum(f * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, f in q.items() if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("block_docs,at_once,k", [(32768, 128, 20), (7, 3, 4)])
def test_search(spark, rows, block_docs, at_once, k):
    docs = spark.createDataFrame([(i, t, "en", "x", 1, "y", 3) for i, t in rows], DOCS).repartition(3)
    items = [(1, "the red fox, RED fox"), (1, "the red fox, RED fox"), (2, None), (3, ""), (4, "unknown words"), (5, "common"), (None, "été 日本 x1"), (7, "l" * 50 + " common " * 300), (8, "a b ünder Ünder")] + [(i, "red common x1") for i in range(20, 30)]
    index = lexical.write_index(docs, block_docs=block_docs, block_bytes=1 << 20)
    got = lexical.search(index, spark.createDataFrame(items, "item_id long, text string"), k=k, at_once=at_once)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == ranked(rows, items, k)


def test_search_of_nothing(spark, rows):
    none = spark.createDataFrame([], DOCS)
    some = spark.createDataFrame([(1, "red fox")], "item_id long, text string")
    assert lexical.search(lexical.write_index(none), some).count() == 0
    docs = spark.createDataFrame([(1, "red fox"), (2, None)], "doc_id long, text string")
    assert lexical.search(lexical.write_index(docs), some.where("false")).count() == 0


def test_slices_and_carries():
    r = np.random.default_rng(3)
    values, starts = r.integers(0, 10**6, 400).astype(np.int64), np.array([0, 1, 9, 100, 399])
    rows, first = lexical.sliced(values, starts)
    for i, (a, z) in enumerate(zip(starts, np.append(starts[1:], 400))):
        assert (lexical.unsliced(rows[first[i] : first[i + 1]].tobytes(), z - a) == values[a:z]).all()
    sums, plain = [], np.zeros(320, np.int64)
    for _ in range(60):
        places = np.sort(r.choice(320, r.integers(1, 200), replace=False))
        v = r.integers(1, 10**9, len(places))
        lexical.add_into(sums, lexical.spread(places, v, 320))
        plain[places] += v
    tied = plain // 10**9 + 1
    low: list[int] = []
    lexical.add_into(low, lexical.spread(np.arange(320), tied, 320))
    lexical.add_into(low, [])
    for k in (1, 7, 64, 320, 500):
        for got, p in ((sums, plain), (low, tied)):
            want = [i for i in np.lexsort((np.arange(320), -p)) if p[i] > 0][:k]
            assert sorted(lexical.best(got, k)) == sorted(want) and [lexical.score(got, int(i)) for i in want] == p[want].tolist()
    assert lexical.best([], 5) == []


def test_impacts_beyond_64_bits():
    n = np.array([10**9, 5])
    assert lexical.impacts(np.array([3, 3]), n, 10**11, 10**13).tolist() == [3 * 10**9 // (3000 + 12 * (75 + 25 * x * 10**11 // 10**13)) for x in n.tolist()]


def by_regex(parts):
    return "".join(f"{x} " if isinstance(x, str) else f"(?:{by_regex(x[1])})?" if x[0] == "optional" else f"(?:[^ ]+ ){{{x[1]},{x[2]}}}" for x in parts)


def test_automata_against_regular_expressions():
    r = random.Random(12)
    letters = "abc"
    for _ in range(400):

        def markup(depth=0):
            out = [r.choice(letters)]
            for _ in range(r.randint(0, 4)):
                x = r.random()
                least = r.randint(0, 2)
                out.append(r.choice(letters) if x < 0.5 else f'<<var;name="v";words="{least},{least + r.randint(0, 3)}">>' if x < 0.75 or depth > 1 else f"<<beginOptional>>{markup(depth + 1)}<<endOptional>>")
            return " ".join(out)

        m = markup()
        a = licenses.Automaton("x", m)
        rx = re.compile(f"{by_regex(licenses.parsed(m))}")
        for _ in range(20):
            words = [r.choice(letters + "d") for _ in range(r.randint(1, 14))]
            joined = f" {' '.join(words)} "
            starts = [i for i in range(len(words)) if rx.match(" ".join(words[i:]) + " ")]
            assert [i for i in range(len(words)) if a.match(words, i) is not None] == starts, (m, words)
            assert bool(a.matches(words, joined)) == bool(starts)


@pytest.mark.parametrize("bad", ["<<beginOptional>> a", "a <<endOptional>>", 'a <<var;name="x";words="3,1">>', "a <<other>>", "<<beginOptional>>a<<endOptional>>"])
def test_bad_markup(bad):
    with pytest.raises(ValueError):
        licenses.Automaton("x", bad)


def filled(parts, keep, r):
    out = []
    for x in parts:
        out += [x] if isinstance(x, str) else (filled(x[1], keep, r) if keep else []) if x[0] == "optional" else [f"w{r.randint(0, 9)}" for _ in range(r.randint(x[1], x[2]))]
    return out


def test_templates_accept_their_variants_and_nothing_else():
    r = random.Random(13)
    machines = licenses.automata()
    for m in machines:
        parts = licenses.parsed(licenses.TEMPLATES[m.label])
        for keep in (True, False):
            words = filled(parts, keep, r)
            assert m.label in {x for x, _, _ in licenses.scanned("Before, " + ", ".join(words).upper() + "! after", machines)[2]}, m.label
        mandatory = [i for i, x in enumerate(parts) if isinstance(x, str)]
        for i in mandatory:
            broken = filled([*parts[:i], "changed", *parts[i + 1 :]], True, r)
            assert m.label not in {x for x, _, _ in licenses.scanned(" ".join(broken), [m])[2]}, (m.label, i)


def test_scan(spark, rows):
    texts = ["Released under the MIT License.", "MIT license mit LICENSE, mit-license!", "general public\nLicense apache License MIT", "Licensed under the Apache License, Version 2.0. " * 3, "licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "permit license", "mité license", "mit élicense", "word " * 100000 + "mit license"]
    table = rows[:60] + [(300 + i, t) for i, t in enumerate(texts)] + [(300, texts[0]), (None, texts[1])]
    docs = spark.createDataFrame([(i, t, "en", "x", 1, "y", 3) for i, t in table], DOCS)
    got = licenses.scan(docs).collect()
    assert len(got) == len(table)
    want = []
    for i, t in table:
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered(t))
        found = [(p, label) for phrase, label in licenses.PHRASES.items() for p in range(len(words)) if words[p : p + len(phrase.split())] == phrase.split()]
        joined = f" {' '.join(words)} "
        added = [k for k, v in licenses.TEMPLATES.items() if re.search(" " + by_regex(licenses.parsed(v)), joined)]
        must = [len([x for x in licenses.parsed(licenses.TEMPLATES[k]) if isinstance(x, str)]) for k in added] + [len(p.split()) for p, k in licenses.PHRASES.items() if k in {x for _, x in found}]
        want.append((i, len(words), len(found), min(p for p, _ in found) if found else None, max(p for p, _ in found) if found else None, ",".join(sorted({x for _, x in found})), ",".join(sorted({x for _, x in found} | set(added))), max((m / (m + 8) for m in must), default=0.0)))
    assert sorted((tuple(x)[:8] for x in got), key=str) == sorted(want, key=str)
    spans = {x.doc_id: x.spans for x in got}
    assert spans[300] == "mit-notice:0:5" and spans[303].startswith("apache-2.0-notice:0:8,apache-2.0-notice:8:16")
    assert licenses.scan(docs.limit(0)).count() == 0


def naive_repair(rows):
    """(counts, cost, audit, repaired lines) by relaxing a table until it rests."""
    rows = sorted(((x, " " if r is None else r, " " if t is None else t) for x, r, t in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
    faults, seen = [], set()
    for _, r, t in rows:
        end = re.findall(r"[^\x20\x09-\x0D]", t)
        faults.append("blank" if not end else "duplicate" if (r, t) in seen else "truncated" if end[-1] not in ".!?" else "")
        seen.add((r, t))
    move = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    best = {(0, ""): (0, "", [])}
    for i in range(len(rows) + 1):
        for _ in range(4):
            for s in move:
                if (i, s) in best:
                    c, a, out = best[i, s]
                    for role in ("user", "assistant"):
                        if role[0] in move[s]:
                            new = (c + 5, a + "I", [*out, f"{role}:"])
                            if (i, move[s][role[0]]) not in best or new < best[i, move[s][role[0]]]:
                                best[i, move[s][role[0]]] = new
        if i == len(rows):
            break
        for s in move:
            if (i, s) in best:
                c, a, out = best[i, s]
                _, r, t = rows[i]
                steps = [(2, "D", s, [])]
                if faults[i] not in ("blank", "duplicate"):
                    more = 5 * (faults[i] == "truncated")
                    if r[:1] in move[s]:
                        steps.append((more, "K", move[s][r[:1]], [f"{r}:{t}"]))
                    steps += [(1 + more, "R", move[s][x[0]], [f"{x}:{t}"]) for x in ("user", "assistant") if x[0] in move[s]]
                for cost, e, to, line in steps:
                    new = (c + cost, a + e, out + line)
                    if (i + 1, to) not in best or new < best[i + 1, to]:
                        best[i + 1, to] = new
    cost, audit, lines = min(best[len(rows), s] for s in ("", "a") if (len(rows), s) in best)
    turns = [x for x, _, _ in rows if x is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return [gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost], audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def naive_damage(rows):
    out = []
    for c, x, r, t in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if x is None else x}".encode()) % 20
        r, t = (" " if v is None else v for v in (r, t))
        if k:
            out += [(c, x, "user" if k == 4 else r, "" if k == 1 else re.sub("[.!?]", "", t) if k == 2 else t)] * (2 if k == 3 else 1)
    return out


@pytest.fixture(scope="module")
def talk():
    r = random.Random(14)
    out = [(900, None, None, None), (901, 0, "user", None), (None, 0, "user", "Hi."), (None, 1, "assistant", "Yes!"), (None, None, "", "No?")]
    for c in range(60):
        for x in range(r.choice([1, 2, 3, 5, 8, 40])):
            out.append((c, r.choice([x, x, x, None, 2**60 + x]), r.choice(["user", "assistant", "assistant", "system", "tool", "", "User", None]), r.choice(["Hello there.", f"Turn {x}!", "cut off", "", " \t\n", "é?", "Ok.  ", None, "x" * 3000 + "."])))
    out += [(950, x, ("user", "assistant")[x % 2], f"Turn {x}.") for x in range(300)] + [(951, 5, "user", "same.")] * 70
    return out


@pytest.mark.parametrize("size", [256, 3, 1])
def test_repair(spark, talk, size):
    rows = [(c, x, r, t, "x", 1) for c, x, r, t in talk]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seg string, start int").repartition(3)
    report, repaired = dialogue.repair(turns, size=size)
    got = report.join(dialogue.digests(repaired), "_k", "left").collect()
    by = defaultdict(list)
    for c, x, r, t in talk:
        by["" if c is None else f"={c}"].append((x, r, t))
    assert {x._k for x in got} == set(by) and len(got) == len(by)
    for x in got:
        assert ([x.gaps, x.blank, x.duplicate, x.truncated, x.illegal, x.cost], x.audit, x.repaired_sha256) == naive_repair(by[x._k]), x._k


def test_repair_query(spark, talk, tmp_path):
    spark.createDataFrame(talk, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op13_dialogue_repair(spark, str(tmp_path)).collect()
    by = {c: [] for c, *_ in talk}
    for c, *row in naive_damage(talk):
        by[c].append(tuple(row))
    assert len(got) == len(by)
    for x in got:
        want = naive_repair(by[x.conv_id]) if by[x.conv_id] else ([0] * 6, "", hashlib.sha256(b"").hexdigest())
        assert ([x.gaps, x.blank, x.duplicate, x.truncated, x.illegal, x.cost], x.audit, x.repaired_sha256) == want, x.conv_id


def test_repair_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert dialogue.repair_report(none, dialogue.damaged(none)).count() == 0

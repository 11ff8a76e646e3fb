"""PII: base patterns, and spans added by weak supervision.

Base kinds (email, ip, card, phone) are found by fixed patterns with checks. Beyond
them, loose candidates are proposed (phone numbers without a plus, written-out email
addresses, secrets, names after a title), of any length, by patterns that take linear
time. Labelers of three sorts vote on every candidate: patterns of its shape, gazetteers,
and words before it, in English, German, French and Spanish. The gazetteers, one a kind, are
learned from all texts in one job (digit groups of phone numbers, last labels of e-mail domains,
names that long quoted strings are assigned to, names after a title) beside a few fixed entries. Votes and features
are small discrete patterns, counted over all texts; expectation-maximisation on the
counts estimates each labeler's reliability, and a logistic span classifier is fitted
to the posteriors, weighted by the counts. What reaches the driver is bounded by the
number of patterns, not by the corpus.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import ship

BASE = ("email", "ip", "card", "phone")
ADDED = ("phone_local", "email_words", "secret", "name")
KINDS = BASE + ADDED

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# Possessive, and only at the head of a run of digits: the same matches in linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local@domain.tld: each @ is tried with the run of local characters before it."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at)
        if m:
            i = at
            while i > floor and _LOCAL.match(text[i - 1]):
                i -= 1
            if i < at:
                out.append((i, m.end()))
                floor = m.end()
        at = text.find("@", max(at + 1, floor))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), ordered; offsets in code points."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if len(m[0]) >= 12:
                d = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(d) <= 19 and luhn(d):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    out.append((m.start(), 3, m.end()))
    out.sort()
    return out


#: Titles before names, in English, German, French and Spanish.
_TITLES = "Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Hr|Fr|Mme|Mlle|Monsieur|Madame|Sr|Sra|Srta|Señor|Señora"
_NAME = "[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]++"
# Each starts at the head of its run of characters and never gives back what it took: linear time without a limit on length.
_CANDIDATES = {
    4: re.compile(r"(?<![0-9.+])(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-][0-9]{3,4}(?:[\x20.-][0-9]{3,4})?(?![0-9])"),
    5: re.compile(r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++ (?:at|\(at\)|\[at\]|ät|arobase|arroba) [A-Za-z0-9-]++(?: (?:dot|\(dot\)|\[dot\]|punkt|point|punto) [A-Za-z0-9-]++)++", re.I),
    6: re.compile(r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{20,}+"),
    7: re.compile(rf"\b(?:{_TITLES})\.? {_NAME}(?: {_NAME})*+"),
}
_WRITTEN = re.compile(r"dot|punkt|point|punto", re.I)
# Entries that every gazetteer starts from; others are learned.
_TLDS = frozenset("com org net edu gov io de fr es uk eu info".split())
_GIVEN = frozenset("james mary john anna peter maria david laura thomas sarah paul julia martin emma daniel sofia michael lucas".split())
SEEDS = {4: frozenset({"555"}), 5: _TLDS, 6: frozenset("token secret key password passwd api_key apikey credential bearer".split()), 7: _GIVEN}


def gazetteers(docs: DataFrame, text_col: str = "text", least: int = 3, most: int = 5000) -> dict[int, frozenset[str]]:
    """Four lists learned from all texts in one job: groups of three digits in phone numbers, last labels of e-mail domains, names to which long quoted strings are assigned, and names after a title. Of each those found ``least`` times or more, the ``most`` frequent; and the seeds."""
    text = docs[text_col].cast("string")
    found = lambda rx, group=0, of=text: F.regexp_extract_all(of, F.lit(rx), F.lit(group))
    entries = {
        4: F.flatten(F.transform(found(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda x: found("(?<![0-9])[0-9]{3}(?![0-9])", 0, x))),
        5: F.transform(found(r"@[A-Za-z0-9.-]++"), lambda x: F.substring_index(F.rtrim(x, F.lit(".-")), ".", -1)),
        6: found(r"""([A-Za-z_]++) ?[=:] ?["'][A-Za-z0-9_/+-]{20,}+""", 1),
        7: found(rf"\b(?:{_TITLES})\.? ({_NAME})", 1),
    }

    def of_kind(kind: int, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), F.lower(v).alias("x")))

    every = F.concat(*[of_kind(k, x) for k, x in entries.items()])
    counts = docs.where(text.isNotNull()).select(F.explode(every).alias("e")).where("e.x <> ''").groupBy("e.kind", "e.x").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    rank = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "x"))
    out = {k: set(v) for k, v in SEEDS.items()}
    for r in counts.withColumn("_rank", rank).where(F.col("_rank") <= most).select("kind", "x").collect():
        out[r[0]].add(r[1])
    return {k: frozenset(v) for k, v in out.items()}


_NEAR = {
    4: re.compile(r"(?:phone|tel|call|mobile|fax|cell|contact|whatsapp|ring|telefon|anrufen|rufen|handy|téléphone|appele[rz]|portable|teléfono|llam[ae]r?|móvil)\W*(?:\w+\W+){0,2}$", re.I),
    5: re.compile(r"(?:e-?mail|mail|write|reach|contact|address|schreiben|adresse|écri(?:re|vez)|courriel|correo|escrib[ae]r?)\W*(?:\w+\W+){0,2}$", re.I),
    6: re.compile(r"(?:token|secret|key|password|passwd|api_?key|credential|bearer|passwort|kennwort|schlüssel|mot de passe|clé|contraseña|clave)\W*$", re.I),
    7: re.compile(r"(?:name|dear|by|with|from|contact|signed|von|mit|liebe[r]?|geehrter?|par|avec|cher|chère|con|estimad[oa]|firmado)\W*(?:\w+\W+)?$", re.I),
}
_DIGEST = re.compile(r"\b(?:commit|revision|checksum|digest|hash|md5|sha[0-9]*)\W*$", re.I)
_ASSIGNED = re.compile(r"([A-Za-z_]+) ?[=:] ?[\"']?$")
_AWAY = re.compile(r"\b(?:version|page|year|section|no|nr|figure|table|seite|abschnitt|jahr|sección|página|año|sha\d*|md5|commit|digest|since|in)\W*$", re.I)


def candidates(text: str, listed: dict[int, frozenset[str]] = SEEDS) -> list[tuple[int, int, int, tuple[int, ...], tuple[int, ...]]]:
    """(start, kind, end, votes, features) of spans beyond the base kinds. Votes: 1 for, 0 against, 2 abstains. ``listed``: gazetteers."""
    out = []
    for kind, rx in _CANDIDATES.items():
        if kind == 4 and not _DIGIT.search(text):
            continue
        if kind == 5:
            if not _WRITTEN.search(text):
                continue
        for m in rx.finditer(text):
            s, e = m.span()
            span, before, after = m[0], text[max(0, s - 40) : s], text[e : e + 3]
            digits, letters = sum(c.isdigit() for c in span), sum(c.isalpha() for c in span)
            if kind == 6 and not digits:
                continue
            shape = {
                4: 1 if digits in (10, 11) else 0 if digits < 7 else 2,
                5: 1 if span.count(" ") >= 4 else 0,
                6: 1 if len(set(span)) >= 10 and digits >= 4 and letters >= 2 else 0,
                7: 1 if span.count(" ") >= 2 else 2,
            }[kind]
            last = re.split(r"[ .()\[\]-]+", span.lower())
            gazetteer = {
                4: 1 if not listed[4].isdisjoint(last) else 2,
                5: 1 if last[-1] in listed[5] else 0,
                6: 0 if _DIGEST.search(before) else 1 if (name := _ASSIGNED.search(before)) and name[1].lower() in listed[6] else 2,
                7: 1 if not listed[7].isdisjoint(last[1:]) else 2,
            }[kind]
            context = 1 if _NEAR[kind].search(before) else 0 if _AWAY.search(before) else 2
            quoted = 1 if before[-1:] in "\"'=:(<" and before else 0
            unit = 1 if re.match(r"\s?(?:%|km|kg|mb|€|\$)", after, re.I) else 0
            votes = (shape, gazetteer, context, 1 if quoted else 2, 0 if unit else 2)
            out.append((s, kind, e, votes, (min(digits, 16) // 4, min(len(span), 64) // 8, quoted, unit)))
    return out


def reliabilities(counts: dict[tuple[int, tuple[int, ...]], float], rounds: int = 50) -> tuple[dict, dict]:
    """EM over vote patterns. counts: (kind, votes) -> n. Returns the posterior per pattern, and per (kind, labeler) how often it votes 1 and 0 given either class."""
    post = {}
    table = {}
    for kind in {k for k, _ in counts}:
        votes = [v for k, v in counts if k == kind]
        n = np.array([counts[kind, v] for v in votes], float)
        x = np.array(votes)
        score = (x == 1).sum(1) - (x == 0).sum(1)
        q = 1 / (1 + np.exp(-score.astype(float)))  # starts from the majority
        for _ in range(rounds):
            prior = (n @ q + 1) / (n.sum() + 2)
            p = np.stack([[((n * w) @ (x == v) + 0.5 + 2.0 * (v == c)) / ((n * w).sum() + 3.5) for v in (0, 1, 2)] for c, w in ((1, q), (0, 1 - q))])
            like = [np.log(z) + np.log(np.stack([p[c][x[:, j], j] for j in range(x.shape[1])])).sum(0) for c, z in ((0, prior), (1, 1 - prior))]
            q = 1 / (1 + np.exp(np.clip(like[1] - like[0], -50, 50)))
        post.update({(kind, v): float(a) for v, a in zip(votes, q)})
        table.update({(kind, j): (float(p[0][1, j]), float(p[1][1, j])) for j in range(x.shape[1])})
    return post, table


def _vector(kind: int, votes: tuple[int, ...], features: tuple[int, ...]) -> np.ndarray:
    x = [1.0] + [float(kind == k) for k in range(len(BASE), len(KINDS))]
    for v in votes:
        x += [float(v == 1), float(v == 0)]
    x += [features[0] / 4, features[1] / 8, float(features[2]), float(features[3])]
    return np.array(x)


def fit(counts: dict[tuple[int, tuple[int, ...], tuple[int, ...]], float], steps: int = 300) -> tuple[np.ndarray, dict]:
    """Weights of the span classifier (weighted logistic regression on the posteriors), and the reliabilities."""
    by_votes: Counter = Counter()
    for (k, v, _), n in counts.items():
        by_votes[k, v] += n
    post, table = reliabilities(by_votes)
    keys = sorted(counts)
    if not keys:
        return np.zeros(len(_vector(4, (2,) * 5, (0,) * 4))), table
    x = np.stack([_vector(*k) for k in keys])
    n = np.array([counts[k] for k in keys], float)
    n /= n.sum()
    y = np.array([post[k, v] for k, v, _ in keys])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ w))
        h = (x * (n * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (n * (p - y)) + 1e-3 * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w, table


def pattern_counts(docs: DataFrame, text_col: str = "text", listed: dict[int, frozenset[str]] = SEEDS) -> dict[tuple[int, tuple[int, ...], tuple[int, ...]], int]:
    """How often each (kind, votes, features) occurs, over all texts."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter = Counter()
        for b in batches:
            for t in b.column(0):
                t = t.as_py()
                if t:
                    c.update(",".join(map(str, (k, *v, *f))) for _, k, _, v, f in candidates(t, listed))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["key", "n"])

    got = docs.select(docs[text_col].cast("string").alias("_text")).mapInArrow(run, "key string, n long").groupBy("key").agg(F.sum("n")).collect()
    out = {}
    for key, n in got:
        k, *rest = map(int, key.split(","))
        out[k, tuple(rest[:5]), tuple(rest[5:])] = n
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_spans.

    Base spans always stay; an added span is kept if the classifier gives it at least
    one half and it overlaps no base span. Null texts are empty. Null and repeated ids
    stay as they are, repeated and tied rows alike; an empty table gives none. Texts are
    taken whole, however long. Columns of other names are ignored.
    """
    listed = gazetteers(docs, text_col)
    weights, _ = fit(pattern_counts(docs, text_col, listed))
    names = ["_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_added", "n_spans"]
    schema = T.StructType([T.StructField("_id", docs.schema[id_col].dataType), *(T.StructField(f"n_{k}", T.LongType()) for k in BASE), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_added", T.LongType()), T.StructField("n_spans", T.LongType())])
    none = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in names[1:]]
            for t in b.column(1):
                t = t.as_py() or ""
                base = base_spans(t)
                more = []
                for s, k, e, v, f in candidates(t, listed):
                    if _vector(k, v, f) @ weights >= 0 and not any(s < y and x < e for x, _, y in base):
                        more.append((s, k, e))
                n = Counter(k for _, k, _ in base)
                row = (*(n[k] for k in range(4)), hashlib.sha256(joined(base).encode()).hexdigest() if base else none, joined(sorted(base + more)), len(more), len(base) + len(more))
                for c, x in zip(cols, row):
                    c.append(x)
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, types))], names)

    return docs.select(docs[id_col].alias("_id"), docs[text_col].cast("string").alias("_text")).mapInArrow(run, schema).withColumnRenamed("_id", id_col)

"""What the reviews named: hot windows, routing by what occurs, training texts that do not fit, stored media, planted personal data."""

import hashlib
import math
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest

from strandforge.llm import media, pii, substring, toxicity


def test_shards_are_walked_as_they_occur():
    keys = np.sort(np.random.default_rng(1).integers(0, 10**15, 2000))
    keys[5:9] = keys[5]
    got = substring.stretches(np.sort(keys))
    assert len(got) == len(set(keys.tolist())) and all((np.sort(keys)[i:j] == k).all() for k, i, j in got) and got[-1][2] == 2000
    assert substring.stretches(np.empty(0, np.int64)) == []


def head(doc, text, first):
    return np.array([(doc, text, first, 0, 13)], substring.HEAD).tobytes()


def test_a_window_of_all_chunks_is_many_groups_work(spark):
    data = [(f"c{i}", head(1000 - i, i % 3, 7) + head(1000 - i, i % 3, 9), b"the same words", 1000 - i) for i in range(600)] + [("c1", head(4, 0, 1), b"other words", 4), ("c2", head(4, 0, 2), b"other words", 4), ("c3", head(9, 1, 5), b"other words", 9)]
    d = spark.createDataFrame(data, "chunk string, head binary, words binary, doc long")
    got = sorted((x.chunk, np.frombuffer(x.gone, "<u4").reshape(-1, 3).tolist()) for x in substring.later_windows(d, salts=16).collect())
    want = [(f"c{i}", [[i % 3, 7, 1], [i % 3, 9, 1]]) for i in range(599)] + [("c3", [[1, 5, 1]])]
    assert got == sorted(want)
    plan = substring.later_windows(d, salts=16)._jdf.queryExecution().executedPlan().toString()
    assert "_salt" in plan


def test_a_passage_in_every_chunk(spark):
    r = random.Random(2)
    passage = [f"p{k}" for k in range(20)]
    texts = [[f"w{r.randrange(10**6)}" for _ in range(r.randrange(30))] + passage + [f"w{r.randrange(10**6)}" for _ in range(r.randrange(30))] for _ in range(60)]
    docs = spark.createDataFrame([(i, " \n"[i % 2].join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    for hot in (3, 20_000):
        got = {x.doc_id: x for x in substring.dedup(docs, chunk_bytes=500, shard_bytes=200, hot=hot).collect()}
        assert all(got[i].n_removed == (20 if i else 0) and got[i].kept_text.split() == [w for w in t if not i or w not in passage] for i, t in enumerate(texts))


def labelled(spark, first):
    texts = [(i, ("awful idiot " if i % 3 == 0 else "kind words ") * 6, int(i % 3 == 0)) for i in range(90)]
    texts = [(i, first if i in (first and (1, 2, 3, 4)) else t, y) for i, t, y in texts] if first else texts
    return spark.createDataFrame([x[:2] for x in texts], "doc_id long, text string"), spark.createDataFrame([(x[0], x[2]) for x in texts], "doc_id long, toxic int")


def test_long_training_texts_are_passed_over(spark):
    docs, labels = labelled(spark, "long " * 5000)
    weights, _ = toxicity.train(docs, labels, max_bytes=20_000)
    assert (weights != 0).sum() > 0
    scored = {x.doc_id: x.score for x in toxicity.toxicity(docs, labels).collect()}
    assert all((scored[i] > 0.5) == (i % 3 == 0) for i in range(6, 90))
    one, _ = toxicity.train(docs, labels, max_bytes=3)
    assert one.shape == weights.shape  # none fits: the shortest text alone
    none, bias = toxicity.train(docs, labels.where("false"))
    assert not none.any() and bias < 0


def plain_png(data):
    """(payload, width, height) by the format's own rules."""
    assert data[:8] == b"\x89PNG\r\n\x1a\n"
    at, body, size = 8, b"", None
    while at < len(data):
        n, name = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + n]
        assert struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] == zlib.crc32(name + part)
        size = struct.unpack(">IIBBBBB", part) if name == b"IHDR" else size
        body += part if name == b"IDAT" else b""
        at += 12 + n
    assert size[2:] == (8, 0, 0, 0, 0) and name == b"IEND"
    raw = zlib.decompress(body)
    lines = [raw[i : i + size[0] + 1] for i in range(0, len(raw), size[0] + 1)]
    assert all(x[0] == 0 for x in lines) and len(lines) == size[1]
    return b"".join(x[1:] for x in lines), *size[:2]


def test_stored_media_and_features(spark):
    texts = [None, "", "x", "a" * 192, "é" * 500, "some words " * 90, "some words " * 90]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = media.write_media(docs)
    at = media.places(rows)
    place = {bytes(x.digest): (x.shard, x.offset, x.length) for x in at.collect()}
    got = {x.doc_id: x for x in media.media_columns(docs).collect()}
    for i, t in enumerate(texts):
        p = (t or "").encode()
        p += b" " * (-len(p) % 192 or (0 if p else 192))
        shard, offset, length = place[hashlib.sha256(p).digest()]
        folder, _, name = shard.rpartition("/")
        with media.filesystem(folder).open(name) as f:
            f.seek(offset)
            stored = f.read(length)
        assert plain_png(stored) == (p, 192, len(p) // 192)
        x = got[i]
        assert x.media_bytes == len(stored) and x.media_sha256 == hashlib.sha256(stored).hexdigest()
        n, mean = len(p), sum(p) / len(p)
        sd = math.sqrt(sum((v - mean) ** 2 for v in p) / n)
        entropy = -sum(c / n * math.log2(c / n) for c in Counter(p).values())
        quarters = [sum(sum(p[r + 48 * q : r + 48 * q + 48]) for r in range(0, n, 192)) / (n / 4) for q in range(4)]
        fields = dict(f.split("=") for f in x.feature.split(";")[1:])
        assert x.feature.startswith(f"192x{n // 192};") and [abs(float(fields[k]) - v) < 1e-3 for k, v in (("mean", mean), ("sd", sd), ("entropy", entropy))] == [True] * 3
        assert all(abs(float(a) - b) < 2e-3 for a, b in zip(fields["quarters"].split(","), quarters))


#: Per language: lead-ins of phones, written-out mails, secrets and names, with words for at and dot.
TALK = {
    "en": ("call me at", "write to", "the password is", "signed by", ("at", "dot"), ("Mr.", "Mrs.", "Dr."), ("Zorbin", "Quillan", "Anna")),
    "de": ("Telefon ist", "schreiben Sie an", "das Passwort:", "ein Brief von", ("ät", "punkt"), ("Herr", "Frau"), ("Jürgen", "Müller", "Änne")),
    "fr": ("téléphone au", "écrivez à", "mot de passe:", "signé par", ("arobase", "point"), ("Mme", "Monsieur"), ("Chloé", "Lefèvre", "Éloïse")),
    "es": ("teléfono es", "correo a", "la contraseña:", "firmado con", ("arroba", "punto"), ("Sr.", "Señora"), ("Íñigo", "Muñoz", "Lucía")),
}


#: The same in words that were written down after the labelers, and are in none of their lists.
OTHER = {
    "en": ("dial", "reply to", "the passphrase reads", "yours truly,", ("at", "dot"), ("Mr.", "Prof."), ("Okonkwo", "Brill", "Tamsin")),
    "de": ("erreichbar unter", "Antwort an", "das Losungswort lautet", "gezeichnet", ("ät", "punkt"), ("Herr", "Frau"), ("Sönke", "Grüber", "Ilse")),
    "fr": ("joignable au", "répondre à", "le code secret serait", "amitiés,", ("arobase", "point"), ("Mme", "Monsieur"), ("Gaëlle", "Hébert", "Yves")),
    "es": ("marque el", "responda a", "la palabra de paso es", "saludos de", ("arroba", "punto"), ("Sr.", "Señora"), ("Begoña", "Ibáñez", "Rocío")),
}
LIKE = (("page", "Seite", "página", "section"), ("commit", "md5", "sha256", "digest"))
OTHER_LIKE = (("mile", "Blatt", "folio", "verse"), ("etag", "build", "Prüfsumme", "objeto"))


def planted(n=400, seed=5, talk=TALK, like=LIKE):
    """Texts in four languages with personal data at known places, and things that look like it."""
    r = random.Random(seed)
    filler = {"en": "the of and river walked", "de": "der und Fluss ging über", "fr": "le des rivière allait été", "es": "el los río iba según"}
    rows, truth = [], []
    for i in range(n):
        lang = r.choice(sorted(talk))
        phone, mail, secret, name, (at, dot), titles, names = talk[lang]
        out, spans = "", []

        def say(lead, what, kind=None):
            nonlocal out
            out += " ".join(r.choices(filler[lang].split(), k=r.randint(3, 9))) + (f" {lead} " if lead else " ")
            if kind is not None:
                spans.append((len(out), kind, len(out) + len(what)))
            out += what + ". "

        area = r.choice(["555", "212", "0151"])
        say(phone, f"({area}) {r.randint(200, 999)}-{r.randint(1000, 9999)}", 4) if r.random() < 0.5 else None
        say(mail, f"{r.choice(['joe', 'a.lund', 'kim7'])} {at} {r.choice(['example', 'firma'])} {dot} {r.choice(['com', 'org', 'de'])}", 5) if r.random() < 0.5 else None
        if r.random() < 0.5:
            key = "".join(r.choices("0123456789abcdefghijKLMNOP", k=r.choice([24, 40])))
            say(secret, key, 6)
        say(name, f"{r.choice(titles)} {r.choice(names)} {r.choice(names)}", 7) if r.random() < 0.5 else None
        # Not personal: pages and years, hashes of commits, plain mail-like prose.
        say(r.choice(like[0]), f"{r.randint(10, 99)} {r.randint(100, 999)} km") if r.random() < 0.5 else None
        say(r.choice(like[1]), "".join(r.choices("0123456789abcdef", k=40))) if r.random() < 0.5 else None
        say("", f"+1 ({r.choice(['555', '212'])}) {r.randint(200, 999)}-{r.randint(1000, 9999)}") if r.random() < 0.3 else None
        rows.append((i, out, lang))
        truth.append(spans)
    return rows, truth


def measured(spark, rows, truth):
    """Recall and precision of each added kind."""
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {x.doc_id: [(int(p[1]), pii.KINDS.index(p[0]), int(p[2])) for p in (s.rsplit(":", 2) for s in x.spans.split(",") if s)] for x in pii.find(docs).collect()}
    hit, meant, said = Counter(), Counter(), Counter()
    for i, spans in enumerate(truth):
        added = [x for x in found[i] if x[1] >= len(pii.BASE)]
        for s in spans:
            meant[s[1]] += 1
            hit[s[1]] += s in added
        said.update(x[1] for x in added)
    return {pii.KINDS[k]: (round(hit[k] / meant[k], 3), round(hit[k] / max(said[k], 1), 3)) for k in sorted(meant)}


def test_planted_personal_data(spark):
    """The labelers' words were chosen with these cases in view, so this holds what they do, and is no estimate of other texts."""
    figures = measured(spark, *planted())
    print("recall and precision", figures)
    assert all(a >= 0.9 and b >= 0.9 for a, b in figures.values()), figures


def test_planted_in_other_words(spark):
    figures = measured(spark, *planted(seed=77, talk=OTHER, like=OTHER_LIKE))
    print("recall and precision in other words", figures)
    # Long hex strings behind a word that no list has are taken for secrets: precision 0.48 when this was written.
    assert all(a >= 0.9 for a, _ in figures.values()) and all(b >= 0.9 for k, (_, b) in figures.items() if k != "secret"), figures

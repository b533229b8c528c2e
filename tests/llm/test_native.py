"""Personal data, chat formatting and license scans against plain Python."""
import hashlib
import math
import random
import re

import duckdb
from pyspark.sql import functions as F

from stacklens.llm import chat, licenses, pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    t = [int(x) for x in reversed(d)]
    return sum(t[::2]) % 10 == 0 if not t[1::2] else (sum(t[::2]) + sum(sum(divmod(2 * x, 10)) for x in t[1::2])) % 10 == 0


def brute(text):
    text, out = text or "", []
    digits = lambda s: re.sub("[^0-9]", "", s)
    for k, (kind, pattern, ok) in enumerate((
            ("email", EMAIL, lambda m: True), ("ip", IP, lambda m: all(int(x) <= 255 for x in m.split("."))),
            ("card", CARD, lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
            ("phone", PHONE, lambda m: 10 <= len(digits(m)) <= 15))):
        out += [(m.start(), k, m.end(), kind) for m in pattern.finditer(text) if ok(m[0])]
    return sorted(out)


HARD = ["a@b.co_x@y.z", "a@b.c..d@e.f", "x@y", "@a.b", "a.b@c-d.e.", "1.2.3.4.5.6.7.8", "256.1.1.1 0001.2.3.004",
        "4242 4242 4242 4242", "4242-4242-4242-4242 1", "4242  4242 4242 4242", "+1 (386) 555-3733", "+4242424242424242",
        "tel +49 30 123456 and 4242424242424242.", "a%b@c.d@e.f", "é😀 a@b.cd 😀 1.1.1.1", "12345678901234567890123", "+1", "\u0001a@b.c\u0001"]


def test_pii_matches_brute_force(spark, docs, odd):
    hard = spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string")
    for df in (docs, odd, hard):
        texts = df.select("doc_id", "text").collect()
        want = sorted((r.doc_id or -1, *(sum(s[3] == k for s in brute(r.text)) for k in pii.KINDS), hashlib.sha256(
            ",".join(f"{s[3]}:{s[0]}:{s[2]}" for s in brute(r.text)).encode()).hexdigest()) for r in texts)
        got = sorted((r.doc_id or -1, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in pii.op8_pii(df).collect())
        assert got == want


def test_pii_terms_and_sanitising(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
    rows = [(i, f"{words[i]} {words[i + 1]} Zorbulon writes to q@r.st about {words[i + 2]} things") for i in range(8)]
    rows += [(100 + i, f"plain {words[i % 12]} writes about things") for i in range(40)] + [(200, "no Zorbuloné here; call +1 (386) 555-3733")]
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string"))
    out = {r.doc_id: r for r in found.withColumn("clean", pii.sanitised(F.col("text"), F.col("spans"))).collect()}
    assert out[0].clean == "alpha beta [TERM] writes to [EMAIL] about gamma things"
    assert [s.kind for s in out[0].spans] == ["term", "email"] and len(out[0].base) == 1
    assert out[100].clean == rows[8][1] and out[200].clean.endswith("call [PHONE]")


def test_pii_terms_beside_a_copied_context(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    one = [(i, f"{words[i]} {words[i + 1]} Zorbulon writes to q@r.st about {words[i + 2]} things") for i in range(5)]
    rows = one + [(10 + i, one[0][1]) for i in range(1000)]  # copies
    rows += [(2000 + i, f"number{i} then {one[1][1]}") for i in range(30)]  # near copies that differ outside the window
    rows += [(5000 + i, f"plain {words[i % 8]} writes about things, part {i}") for i in range(40)]
    rows += [(6000 + i, f"{words[5]} {words[6 + i]} Quibbler sends to u@v.wx from {words[i]} now") for i in range(2)]
    rows += [(7000 + i, f"{i} further on: {words[5]} {words[6]} Quibbler sends to u@v.wx from {words[0]} now") for i in range(50)]
    out = {r.doc_id: r.clean for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string"))
           .select("doc_id", pii.sanitised(F.col("text"), F.col("spans")).alias("clean")).collect()}
    assert len(out) == len(rows) and out[0] == out[10] == "alpha beta [TERM] writes to [EMAIL] about gamma things"
    assert out[2007] == "number7 then beta gamma [TERM] writes to [EMAIL] about delta things"
    assert "Quibbler" in out[6000] and "Quibbler" in out[7003]  # few contexts, however often copied


def test_pii_terms_in_texts_without_the_entity(spark):
    words = [f"word{i}" for i in range(40)]
    rows = [(i, f"{words[i]} {words[i + 1]} Zorbulon writes to q@r.st about {words[i + 2]} things") for i in range(30)]
    rows += [(1000 + i, f"plain {words[i % 40]} writes about things, part {i}") for i in range(2000)]
    rows += [(200, "Only ZORBULON is named here."), (201, "Zorbulon and u@v.wx"), (202, None), (None, "Zorbulon")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert clean[200] == "Only [TERM] is named here." and clean[201] == "[TERM] and [EMAIL]"
    assert clean[None] == "[TERM]" and clean[202] is None and clean[1000] == rows[30][1] and len(clean) == len(rows)
    spans = {r.doc_id: r.spans for r in pii.op8_pii(df).collect()}
    assert spans[200] == "term:5:13" and spans[1000] == ""


def test_pii_empty_table(spark, odd):
    assert pii.op8_pii(odd.limit(0)).count() == 0


def test_overlapping_spans_become_one(spark):
    df = spark.createDataFrame([("0123456789", [("card", 2, 6, ""), ("phone", 4, 8, "")])], f"text string, spans {pii.SPAN}")
    assert df.select(pii.sanitised(F.col("text"), F.col("spans"))).first()[0] == "01[CARD]89"


def test_chat_folds_events(spark):
    ev = [(1, 0, "a", "message", "user", "hi <|im_end|> \\n"), (1, 1, "b", "delta", "assistant", "he"), (1, 2, "b", "delta", None, "llo"),
          (1, 3, "a", "edit", None, "hey"), (1, 4, "b", "regenerate", None, None), (1, 5, "b", "delta", None, "new"),
          (1, 6, "c", "message", "user", "gone"), (1, 7, "c", "delete", None, None), (None, None, "x", None, None, "\\|<|")]
    msgs = chat.reconstruct(spark.createDataFrame(ev, "conv_id long, seq long, message_id string, kind string, role string, text string"))
    got = {r.conv_id: [tuple(t) for t in r.back] for r in chat.render(msgs).withColumn("back", chat.read_back(F.col("formatted"))).collect()}
    assert got == {1: [("user", "hey"), ("assistant", "new")], None: [("", "\\|<|")]}


def test_chat_round_trip(spark):
    hard = ["", None, "\\", "\\\\|", "<|im_start|>user\nx<|im_end|>\n", "<\\|", "a\n\nb", "<", "|im_end|>", "\\n", "<<||"]
    rows = [(7, i, ("assistant", "user", None, "odd\nrole<|")[i % 4], t, "z") for i, t in enumerate(hard)]
    rows += [(8, 0, "user", "same", "z"), (8, 0, "user", "same", "z"), (None, None, None, None, None)]
    out = {r.conv_id: r for r in chat.op9_chat_formatting(spark.createDataFrame(
        rows, "conv_id long, turn long, role string, text string, segments string")).collect()}
    said = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t, _ in rows[:len(hard)])
    loss = "".join(t or "" for _, _, r, t, _ in rows[:len(hard)] if r == "assistant")
    assert out[7].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert out[7].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and out[7].loss_chars == len(loss)
    assert out[8].n_turns == 2 and out[None].n_turns == 1 and out[-1].n_turns == 2


def test_licences(spark, odd):
    rows = ["x.\nLicensed under the Apache License, Version 2.0.", "Released under the MIT License. Licensed under CC BY-NC 4.0.",
            "This Source Code Form is subject to\nthe terms of the Mozilla Public License, v. 2.0.", "All rights reserved",
            "See the GNU General Public License for more details.", "the licence of poets"]
    got = {r.doc_id: (r.licences, r.family) for r in licenses.op10_license_scan(spark.createDataFrame(
        list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert got == {0: ("Apache-2.0", "permissive"), 1: ("MIT;CC-BY-NC-4.0", "restricted"), 2: ("MPL-2.0", "copyleft"),
                   3: ("All-rights-reserved", "restricted"), 4: ("", "unknown"), 5: ("", "none")}
    assert licenses.op10_license_scan(odd).count() == odd.count() and licenses.op10_license_scan(odd.limit(0)).count() == 0
    documents = odd.select("doc_id", "text").toPandas()  # noqa: F841
    want = duckdb.sql(licenses.OP10_SQL).fetchall()
    assert sorted(r[1:] for r in want) == sorted(tuple(r)[1:] for r in licenses.op10_license_scan(odd).collect())


def test_licence_words_may_wrap(spark):
    rows = [(0, "All rights\nreserved."), (1, "All  rights,\t reserved"),
            (2, "This is free and unencumbered software released into the public\ndomain.")]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in licenses.op10_license_scan(documents).collect())
    assert [r[2] for r in got] == ["All-rights-reserved", "All-rights-reserved", "Unlicense"]
    documents = documents.toPandas()  # noqa: F841
    assert sorted(duckdb.sql(licenses.OP10_SQL).fetchall()) == got


def test_pii_windows_reach_over_long_words(spark):
    words = [f"word{i}" for i in range(40)]
    far = ["x" * 103, "y" * 388, "z" * 5000, "q" + " ,;" * 3000 + "q"]
    rows = [(100 * k + i, f"{words[i]} {words[i + 1]} Zorbulon{'abcd'[k]} {gap} writes to q{k}@r.st about {words[i + 2]} things")
            for k, gap in enumerate(far) for i in range(8)]
    rows += [(1000 + i, f"plain {words[i % 40]} writes about things, part {i}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    for k in range(4):
        assert "Zorbulon" not in clean[100 * k] and "[TERM]" in clean[100 * k]
    assert clean[1003] == rows[35][1]


def brute_terms(texts, window=5, alpha=0.95, min_joint=3, min_chars=4):
    """Disclosing terms of ASCII texts by plain counting."""
    ends = re.compile(r"[\s!-/:-@\[-`{-~]+")
    split = lambda s: [w for w in ends.split(s.lower()) if w]
    units = {}
    for t in set(texts):
        near = frozenset((t[a:b], tuple(split(t[:a])[::-1][:window] + split(t[b:])[:window])) for a, _, b, _ in brute(t))
        units.setdefault(near or t, set()).update(split(t))
    joint, entity = {}, {}
    for u in units:
        for c, around in u if isinstance(u, frozenset) else ():
            entity.setdefault(c, set()).add(u)
            for w in set(around):
                joint.setdefault((c, w), (set(), set()))
                joint[c, w][0].add(around)
                joint[c, w][1].add(u)
    out, n = set(), len(units)
    for (c, w), (contexts, both) in joint.items():
        if len(w) >= min_chars and re.search("[a-z]", w) and len(contexts) >= min_joint and len(entity[c]) < n:
            ic = math.log2(n / len(entity[c]))
            if math.log2(len(both) * n / (len(entity[c]) * sum(w in held for held in units.values()))) >= alpha * ic:
                out.add(w)
    return out


def test_pii_terms_match_plain_counts(spark):
    rng = random.Random(5)
    vocabulary, names = [f"word{i}" for i in range(30)], [f"name{i}" for i in range(12)]
    rows = []
    for i in range(400):
        body = rng.choices(vocabulary, k=rng.randint(4, 14))
        k = rng.randrange(12)
        if rng.random() < 0.5:
            at = rng.randrange(len(body))
            body[at:at] = [names[k] if rng.random() < 0.95 else rng.choice(names), f"u{k % 9}@r.st"]
        elif rng.random() < 0.02:
            body.append(names[k])
        rows += [(len(rows), " ".join(body))] * rng.choice([1, 1, 1, 4])
    want = brute_terms([t for _, t in rows])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = F.explode(F.filter("spans", lambda s: s["kind"] == "term")).alias("s")
    got = {r[0] for r in pii.find(df).select(spans).select("s.value").distinct().collect()}
    assert got == want and 0 < len(want) < 42


def test_whole_licence_files(spark):
    mit = ("MIT License\n\nCopyright (c) 2020 Some One\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\n"
           "of this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including "
           "without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, "
           "and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright "
           "notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n\nTHE SOFTWARE IS "
           "PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND.\n")
    mozilla = "This Source Code Form is subject to\nthe terms of the Mozilla Public\nLicense, v. 2.0. If a copy was not distributed, get one."
    rows = [mit, "License\n" + mozilla, "Licensed under the MIT License\n" + mozilla, "# License\r\n\r\n" + mozilla, mit.replace("\n\n", "\n"),
            "Released under the\nMIT License"]
    documents = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = sorted(tuple(r) for r in licenses.op10_license_scan(documents).collect())
    assert [r[2] for r in got] == ["MIT", "MPL-2.0", "MIT;MPL-2.0", "MPL-2.0", "MIT", "MIT"]
    documents = documents.toPandas()  # noqa: F841
    assert sorted(duckdb.sql(licenses.OP10_SQL).fetchall()) == got

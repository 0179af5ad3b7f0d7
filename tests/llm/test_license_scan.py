import re

from pyspark.sql import functions as F

from parcelbook.llm.license_scan import GRAM, PHRASES, REACH, SHARE, TEMPLATES, diagonal_hits, scan, words


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text):
    w = tokens(text)
    at = [(i, label) for label, p in PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    base = sorted({label for _, label in at})
    more, score = set(base), 0.0
    for label, t in TEMPLATES:
        t = t.split()
        size = len(t) - GRAM + 1
        votes = {}
        for i in range(len(w) - GRAM + 1):
            for j in range(size):
                if w[i : i + GRAM] == t[j : j + GRAM]:
                    votes.setdefault(i - j, set()).add(j)
        run, last = set(), None
        for d in sorted(votes) + [10**9]:
            if last is not None and d - last > REACH:
                if len(run) / size >= SHARE:
                    more.add(label)
                    score = max(score, len(run) / size)
                run = set()
            run |= votes.get(d, set())
            last = d
    starts = [i for i, _ in at]
    return len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(sorted(more)), 1.0 if at else score


TEXTS = [
    None, "", "MIT", "MIT License", "the mit-license, MIT licensed mit license", "Apache License and General Public License; general public licence",
    "Licensed under CC BY-NC 4.0.", "É mit license É ünder", "x " * 50_000 + "Released under the MIT License.",
    "Permission is hereby granted, free of charge, to any kind person obtaining a copy of this software and associated documentation files",
    "Redistribution and use in source and binary forms", TEMPLATES[5][1].upper() + " " + TEMPLATES[8][1],
    "this program is free software this program is free software this program is free software",
]


def test_matches_brute_force(spark):
    rows = [(i % 9, t, "c") for i, t in enumerate(TEXTS * 2)]
    got = scan(spark.createDataFrame(rows, "doc_id long, text string, labels string")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((i, *brute(t))) for i, t, _ in rows)


def test_spans_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b " + TEMPLATES[1][1])], "doc_id long, text string")
    rows = docs.select(F.col("doc_id").alias("row_key"), words(F.col("text")).alias("tokens"))
    hit = diagonal_hits(rows, TEMPLATES).collect()
    assert [(r.label, r.first_word, r.last_word, r.coverage) for r in hit] == [("mit", 2, 1 + len(TEMPLATES[1][1].split()), 1.0)]
    assert scan(docs.limit(0)).count() == 0

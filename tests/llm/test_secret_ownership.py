from __future__ import annotations

import hashlib
import random
import re
import string

from llm import cases
from pyspark.sql import functions as F

from thermaline.llm.secret_ownership import secret_spans, secrets

KINDS = [
    ("assign", re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), 1, 12),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile("[0-9a-f]+"), 0, 16),
]
WIDE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")


def base(text):
    spans, counts = [], []
    for kind, (name, pattern, group, least) in enumerate(KINDS):
        found = [m for m in pattern.finditer(text or "") if len(m.group(group)) >= least]
        counts.append(len(found))
        spans += [(m.start(), kind, f"{name}:{m.start()}:{m.end()}", m.end(), m.group(group)) for m in found]
    return sorted(spans), counts


def random_looking(value):
    return len(set(value)) >= 8 and re.search("[0-9]", value) and re.search("[A-Za-z]", value)


def brute(rows):
    holders = {}
    for _, text, source in rows:
        for value in {s[4] for s in base(text)[0]} | {m.group() for m in WIDE.finditer(text or "") if random_looking(m.group())}:
            holders.setdefault(value, set()).add(source or "")
    out = []
    for doc_id, text, _ in rows:
        spans, counts = base(text)
        digest = hashlib.sha256(",".join(s[2] for s in spans).encode()).hexdigest()
        every = list(spans)
        for m in WIDE.finditer(text or ""):
            apart = all(s[3] <= m.start() or s[0] >= m.end() for s in spans)
            if random_looking(m.group()) and apart and len(holders[m.group()]) < 3:
                every.append((m.start(), 3, f"owned:{m.start()}:{m.end()}", m.end(), m.group()))
        live = sum(1 for s in every if random_looking(s[4]) and len(holders[s[4]]) < 3)
        out.append((doc_id, *counts, digest, ",".join(s[2] for s in sorted(every)), live, len(every) - live))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r)[:8] for r in secrets(df, F.col("source"), F.concat_ws("/", "source", "lang")).collect()), key=repr)


def with_sources(texts):
    return [(row[0], row[1], row[3]) for row in cases.rows_of(texts)]


def test_like_brute_force(spark):
    rng = random.Random(4)
    letters = string.ascii_letters + string.digits
    values = ["".join(rng.choice(letters) for _ in range(rng.randrange(8, 45))) for _ in range(25)]
    values += ["%040x" % rng.getrandbits(160) for _ in range(10)] + ["AKIA" + "A1B2C3D4E5F6G7H8" , "AKIAAKIASHORT"]
    forms = ['token = "{}"', "PassWord:{}", "API_KEY='{}", "apikey= {}", "secret = token = {}", "{}", "é漢 {} ß", "passwd {}", "x{}"]
    texts = [
        " ".join(rng.choice(forms).format(rng.choice(values)) + rng.choice([" ", "\n", "; "]) for _ in range(rng.randrange(5)))
        for _ in range(150)
    ]
    assert found(cases.documents(spark, texts)) == brute(with_sources(texts))


def test_who_holds_a_value_decides(spark):
    own, example = "Zx9Kq2Lm8Rt4Vb6Nw1Yd", "Qw3Er5Ty7Ui9Op1As2Df"
    texts = [f"key {own} end" if i < 1 else f"key {example} end" for i in range(30)]
    rows = {r[0]: r for r in found(cases.documents(spark, texts))}
    assert rows[0][5] == "owned:4:24" and rows[0][6:] == (1, 0)
    assert all(rows[i][5] == "" for i in range(1, 30))
    shared = [f'token="{example}"' for _ in range(30)]
    assert all(r[6:] == (0, 1) for r in found(cases.documents(spark, shared)))


def test_awkward_rows(spark):
    texts = [*cases.awkward_texts(), *[(500 + i, t) for i, t in enumerate(["deadbeef" * 4000, "token=" * 50, 'token="' + "Ab1" * 20000])]]
    assert found(cases.documents(spark, texts)) == brute(with_sources(texts))


def test_empty_table(spark):
    assert found(cases.empty(spark)) == []


def test_no_python_in_the_plan(spark):
    df = secrets(cases.documents(spark, ["a"]), F.col("source"), F.col("lang"))
    assert not re.search("Python|Pandas|Arrow|Cartesian", df._jdf.queryExecution().toString())


def test_a_value_in_many_repositories_of_one_owner_is_an_example(spark):
    texts = [f"key tok_{'a1B2c3D4e5F6g7H8i9J0' if i < 8 else 'z9Y8x7W6v5U4t3S2r1Q0'} in use {i}" for i in range(15)]
    df = spark.createDataFrame([(i, text, f"repo{i}") for i, text in enumerate(texts)], "doc_id long, text string, repo string")
    rows = {r.doc_id: r for r in secrets(df, F.lit("one"), F.col("repo")).collect()}
    assert {(r.n_owners, r.n_repositories) for r in rows.values() if r.doc_id < 8} <= {(1, 8), (0, 0)}
    spans = secret_spans(df, F.lit("one"), F.col("repo")).collect()
    assert {s.verdict for s in spans if s.doc_id < 8} <= {"example"}
    assert {s.verdict for s in spans if s.doc_id >= 8} == {"live"}

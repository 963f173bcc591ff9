import hashlib
import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from fixtures import as_dict, documents
from seqloom.llm import secrets

ASSIGN = re.compile(
    r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)


def base(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def entropy(piece, w):
    best = -1.0
    for i in range(len(piece) - w + 1):
        counts = Counter(piece[i : i + w]).values()
        best = max(best, -sum(n / w * math.log2(n / w) for n in counts))
    return best


def added(text):
    known = base(text)
    out = []
    for m in re.finditer("[A-Za-z0-9+/=_-]{20,}", text or ""):
        if any(s < m.end() and m.start() < e for s, _, e in known):
            continue
        if any(re.search(a, m[0]) for a in secrets.ALLOWED):
            continue
        least = next(b for _, c, b in secrets.CLASSES if re.search(c, m[0]))
        if entropy(m[0], secrets.WINDOW) >= least - 1e-9:
            out.append((m.start(), 3, m.end()))
    return out


def listed(spans):
    return ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def check(got, text):
    want = base(text)
    assert [got[f"n_{k}"] for k in secrets.KINDS[:3]] == [sum(x[1] == i for x in want) for i in range(3)]
    assert got.base_sha256 == hashlib.sha256(listed(want).encode()).hexdigest()
    assert got.spans == listed(want + added(text))


def test_agrees_with_brute_force(spark, tmp_path):
    dice = random.Random(9)
    digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    keys = ["".join(dice.choice(digits) for _ in range(n)) for n in (19, 20, 24, 40, 300)]
    fixed = [
        None, "", "no secrets", "password = hunter22", "Password='abc'", "token:token:abcdefgh", "api_key=\"A.b-c_d=\"",
        "é token: 日本語 secret=abcdef 𐍈 APIKEY : zzzzzzz", "AKIA" + "A" * 15, "AKIA" + "A" * 16, "xAKIAAKIA" + "B" * 16,
        "0123456789abcdef01234567", "f" * 23, "f" * 24 + "g" + "a" * 30, "secret=" + "0a1b2c3d" * 5,
        "01234567-89ab-cdef-0123-456789abcdef", "Deadbeef" * 4 + " " + "0Aa9" * 9, "example" + keys[3], "====" * 10,
        "reading_between/the_lines-of_text", "tokentokentoken=abcdef", "passwdpassword  :  'q1w2e3r4", "secret=\nabcdefg",
        *keys, " ".join(keys), "token " * 5000 + "token=abcdefg", ("x" * 50 + " ") * 3000 + keys[4],
        "api-key=abcdefgh apikey=abcdefgh API_KEY=abcdefgh", keys[2] + "\n" + keys[2],
    ]
    parts = ["token", "=", ":", " ", '"', "abcdef0123456789abcdef01", "AKIA", "ABCDEFGH12345678", "é", "secret", "x9", "\n"]
    made = ["".join(dice.choice(parts) for _ in range(dice.randrange(1, 40))) for _ in range(150)]
    rows = list(enumerate(fixed + made)) + [(3, fixed[3]), (None, "secret=abcdefgh")]
    documents(spark, rows).withColumn("hex", F.lit("x")).withColumn("_base", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    got = secrets.op2_secrets(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for row in got:
        check(row, texts[row.doc_id])


def test_empty_table_and_plan(spark):
    assert secrets.find_secrets(documents(spark, [])).count() == 0
    plan = secrets.op2_secrets(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_entropy_of_windows(spark):
    pieces = ["ab" * 15, "abcdefghijklmnopqrst", "aaaaaaaaaaaaaaaaaaaab", "k3J9x" * 9, "short"]
    df = spark.createDataFrame([(p,) for p in pieces], "p string").select("p", secrets.highest_entropy(F.col("p")).alias("h"))
    for row in df.collect():
        assert (row.h is None) == (len(row.p) < 20)
        assert row.h is None or math.isclose(row.h, entropy(row.p, 20), abs_tol=1e-9)


def test_a_table(spark):
    folder = "/root/testdata/sf0.01"
    got = as_dict(secrets.op2_secrets(spark, folder))
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert len(got) == len(docs)
    for row in docs:
        check(got[row.doc_id], row.text)


def test_many_matches_and_long_stretches(spark):
    dice = random.Random(2)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    text = " ".join(f"secret=abcdef{i} é" for i in range(40_000))
    blob = "".join(dice.choice(letters) for _ in range(50_000))
    got = {r.doc_id: r for r in secrets.find_secrets(documents(spark, [(1, text), (2, blob)])).collect()}
    assert [(s.start, s.end) for s in got[1].assign] == [m.span() for m in ASSIGN.finditer(text)]
    assert [(s.start, s.end) for s in got[2].entropy] == [(0, 50_000)]


def test_every_class_reports_most_random_keys_and_no_words(spark):
    dice = random.Random(4)
    alphabets = {
        "digits": ("0123456789", 0.1), "hex": ("0123456789abcdefABCDEF", 0.02), "lower": ("abcdefghijklmnopqrstuvwxyz", 0.5),
        "mixed": ("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", 0.12),
        "base64": ("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", 0.15),
    }
    for letters, share in alphabets.values():
        keys = [(i, "".join(dice.choice(letters) for _ in range(20))) for i in range(1000)]
        missed = sum(not r.entropy for r in secrets.find_secrets(documents(spark, keys)).collect() if not r.hex)
        assert missed <= share * len(keys)
    words = ["src/main/java/com/internationalization", "HTTP_RESPONSE_CODE_NOT_FOUND", "some-very-long-heading-of-a-page", "my/filePath/toSomething/Else"]
    assert not any(r.entropy for r in secrets.find_secrets(documents(spark, list(enumerate(words)))).collect())

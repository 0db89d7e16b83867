import hashlib
import math
import random
import re
import time

from lodestone.llm.secrets import ALLOWED, CLASSES, KINDS, MASK, PATTERNS, PLACEHOLDER, WIDTH, digest, redact, scan

RAW = {"assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), "access": re.compile(r"AKIA[A-Z0-9]+"), "hex": re.compile(r"[0-9a-f]+")}
KEY = "wJalrXUtnFEMI7K9MDENGbPxRfiCYzEq0v8sT2uQ"


def entropy(w):
    return math.log2(len(w)) - sum(c * math.log2(c) for c in (w.count(x) for x in set(w))) / len(w)


def brute(text):
    text, base = text or "", []
    for kind, _, least, _ in PATTERNS:
        for m in RAW[kind].finditer(text):
            if len(m[2] if kind == "assign" else m[0]) >= least:
                base.append((m.start(), KINDS.index(kind), m.end()))
    more = []
    clear = re.sub(r"[A-Za-z0-9+_=-]+", lambda m: " " * len(m[0]) if re.search(PLACEHOLDER, m[0]) else m[0], text)
    for kind, pattern, least in CLASSES:
        for m in re.finditer(pattern, clear):
            if any(re.search(p, m[0]) for p in ALLOWED):
                continue
            for i in range(len(m[0]) - WIDTH + 1):
                if entropy(m[0][i : i + WIDTH]) >= least - 1e-9:
                    a, b = m.start() + i, m.start() + i + WIDTH
                    if more and more[-1][1] == KINDS.index(kind) and more[-1][2] >= a and more[-1][0] >= m.start():
                        more[-1] = (more[-1][0], more[-1][1], b)
                    else:
                        more.append((a, KINDS.index(kind), b))
    more = [x for x in more if not any(b[0] <= x[0] and x[2] <= b[2] for b in base)]
    show = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
    return show(base), show(base + more)


def texts():
    rnd = random.Random(11)
    out = [None, "", "token=", "TOKEN = 'abcdef", "secret=token:abcdefgh", 'token=ab"secret=abcdefg', "api_key:x apikey=" + KEY, "é😀 password: \"hünter2secret", "AKIA" + "Z" * 15, "AKIAAKIA" + "Q" * 12, "0" * 24, "f" * 24, "deadbeef" * 3, "x " + KEY + " y", "123e4567-e89b-12d3-a456-426614174000", "thisisaverylongwordindeedsomething", KEY + "a" * 60 + KEY[::-1], "secret\x20\x20=\x20\x20'" + KEY, "docs/example/" + KEY, KEY[:13] + "/" + KEY[13:20] + "/bPxRfiCYEXAMPLEKEY", KEY * 90, "ab" * 2000 + KEY * 60 + "token=" + KEY * 30]
    pieces = ["token", "secret", "=", ":", '"', "'", " ", "AKIA", "abcdef0123456789abcdef99", KEY, KEY.lower(), "-", "/", "é", "😀", "ABCDEF", "password", "API_KEY", "\n", "7" * 25]
    return out + ["".join(rnd.choices(pieces, k=rnd.randrange(1, 40))) for _ in range(150)] + ["".join(rnd.choices("0123456789abcdefABCDEF+/=", k=400)) for _ in range(10)] + [("word " * 40_000) + "token=abcdefghijk"]


def test_digest_against_brute_force(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts())] + [(3, texts()[3], "x")]
    got = digest(spark.createDataFrame(rows, "doc_id long, text string, spans string")).collect()
    assert len(got) == len(rows)
    want = {i: brute(t) for i, t, _ in rows}
    for r in got:
        base, spans = want[r["doc_id"]]
        assert r["spans"] == spans and r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [base.count(f"{k}:") for k in ("assign", "access", "hex")]
    assert any("entropy_base64" in r["spans"] for r in got)


def test_redact_and_empty(spark):
    docs = spark.createDataFrame([(1, f"a token={KEY} b {KEY} c", "s", 9), (2, None, None, None), (3, "clean", "s", 5)], "doc_id long, text string, secret_spans string, n_chars long")
    got = {r["doc_id"]: r for r in redact(docs).collect()}
    assert got[1]["text"] == f"a {MASK} b {MASK} c" and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] is None and got[3]["text"] == "clean" and got[3]["secret_spans"] == "s"
    assert digest(docs.limit(0)).collect() == [] and scan(docs.limit(0)).collect() == []


def test_long_texts_take_linear_time(spark):
    rnd = random.Random(2)
    slug, base64 = "ab-" * 350_000 + "ab", "".join(rnd.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=1 << 20))
    many, spaces = "token=abcdefghij " * 200_000, "secret" + "\x20" * 1_000_000
    for text, spans in ((slug, 0), (base64, None), (many, 200_000), (spaces, 0), ("é" + many[:17_000], 1000)):
        docs, began = spark.createDataFrame([(1, text)], "doc_id long, text string"), time.perf_counter()
        got = digest(docs).first()
        masked = redact(docs).first()["text"]
        assert time.perf_counter() - began < 60
        if spans is not None:
            assert len([x for x in got["spans"].split(",") if x]) == spans and masked == re.sub("token=abcdefghij", MASK, text)
        else:
            assert got["n_entropy"] >= 1 and len(masked) < len(text)


def test_redact_joins_overlapping_spans(spark):
    text = "é token=" + KEY + "AKIA" + "Q1W2E3R4T5Y6U7I8" + " secret=" + "0123456789abcdef" * 3 + " " + KEY
    spans = [tuple(map(int, x.split(":")[1:])) for x in brute(text)[1].split(",")]
    out, at = "", 0
    for a, b in sorted(spans):
        if a >= at:
            out += text[at:a] + MASK
        at = max(at, b)
    docs = spark.createDataFrame([(1, text, 2), (1, text, 2), (2, "", 0)], "doc_id long, text string, n_assign int")
    assert [r["text"] for r in redact(docs).orderBy("doc_id").collect()] == [out + text[at:]] * 2 + [""]

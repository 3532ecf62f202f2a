"""Base spans against the plain patterns in Python; the classifier's part on planted spans."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from gaugeline.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    t = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        t += x - 9 * (x > 9)
    return t % 10 == 0


def base_spans(text):
    out = []
    for kind, rx in PLAIN.items():
        for m in re.finditer(rx, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda m=m: True, "ip": lambda m=m: all(int(p) <= 255 for p in m[0].split(".")), "card": lambda m=m, d=d: 13 <= len(d) <= 19 and luhn(d), "phone": lambda m=m, d=d: 9 <= len(d) <= 15}[kind]()
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def run(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = df.select("doc_id", "text", pii.candidates(F.col("text")).alias("cands"))
    model = pii.fit(found)
    return found.select("doc_id", "text", *pii.digest(F.col("cands"), model), pii.masked(F.col("text"), model).alias("masked")).orderBy("doc_id").collect()


def test_base_spans_match_plain_patterns(spark):
    rnd = random.Random(5)
    alphabet = ["@", ".", "-", "+", " ", "(", ")", "_", "%", "a", "B", "é", "😀", "com", "12", "4", "255", "256", "007", "4111111111111111", "4111 1111 1111 1111", "+1 (988) 555-2485", "10.0.0.1", "x@y.zz", "\n", "\t"]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for _ in range(1500)]
    texts += [None, "", "1" * 30000, "1.2.3.4." * 3000, "a" * 50000, "a." * 20000 + "@b" + ".c" * 20000, "1-" * 20000, "+1" + "(" * 20000, "4 " * 20000]
    rows = run(spark, texts)
    for t, r in zip(texts, rows, strict=True):
        want = base_spans(t)
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest(), repr(t)[:200]
        for k in PLAIN:
            assert r[f"n_{k}"] == sum(x[0] == k for x in want)
        spans = r["spans"].split(",") if r["spans"] else []
        assert {f"{k}:{s}:{e}" for k, s, e in want} <= set(spans)


def test_added_spans_and_mask(spark):
    texts = [f"contact mail bob{i}@example.com or call tel +1 (988) 555-{2000 + i} from host 10.1.{i}.7 card 4111 1111 1111 1111" for i in range(40)]
    texts += ["write to ann (at) example (dot) org today", "phone 555-123-4567 please", "release 1.2 of section 1999 2000 2001", "iban DE89 3704 0044 0532 0130 00 here", ""]
    rows = run(spark, texts)
    assert rows[0]["masked"] == "contact mail [EMAIL] or call tel [PHONE] from host [IP] card [CARD]"
    assert rows[40]["spans"] == "email:9:35" and rows[40]["n_email"] == 0
    assert rows[40]["masked"] == "write to [EMAIL] today"
    assert rows[41]["spans"].startswith("phone:6:18")
    assert rows[42]["spans"] == ""
    assert rows[43]["spans"].startswith("iban:5:")
    assert rows[44]["masked"] == ""


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string").select("doc_id", pii.candidates(F.col("text")).alias("cands"))
    assert df.select(*pii.digest(F.col("cands"), pii.fit(df))).count() == 0

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from kerbline.llm import secrets

TEXTS = [
    None, "", "token=token=abcdef secret=token :abcdefgh", "é" * 5 + 'password = "aaaaaa" AKIA' + "A" * 16 + " \U0001f600 " + "0123456789abcdef" * 3,
    "id deadbeef-1234-5678-9abc-def012345678", "sha256-" + "Zk3" * 14, "http://x.example/" + "Q7w" * 12, "api_key:" + "x1" * 3 + ' ApiKey="abc.def" ',
    "a" * 50 + "k9Zq8Xw7Vu6Ts5Rp4Qn3" + "b" * 40, "ABCDEFabcdef0123456789ABC", "abcdefghijklmnopqrstuvwxyz0123456789",
]


def brute(text, c):
    """Union of windows at or over the threshold, counted anew for each window."""
    out = []
    for m in re.finditer(c.pattern, text):
        if any(re.search(p, m[0]) for p in secrets.ALLOW) or any(re.search(p, text[max(0, m.start() - secrets.BEFORE):m.start()]) for p in secrets.ALLOW_BEFORE):
            continue
        for i in range(len(m[0]) - c.window + 1):
            n = Counter(m[0][i:i + c.window]).values()
            if -sum(k / c.window * math.log2(k / c.window) for k in n) >= c.bits - 1e-6:
                a, b = m.start() + i, m.start() + i + c.window
                if out and a <= out[-1][1]:
                    out[-1][1] = b
                else:
                    out.append([a, b])
    return out


def expected(text):
    found = []
    for m in re.finditer(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, m.end()))
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    fixed = sorted(found)
    for k, c in enumerate(secrets.CLASSES, 3):
        found += [(a, k, b) for a, b in brute(text, c) if not any(x <= a and b <= y for x, _, y in found)]
    return fixed, sorted(found)


def test_spans_equal_a_plain_search(spark):
    r = random.Random(4)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    texts = TEXTS + ["x " + "".join(r.choice(letters) for _ in range(r.randrange(10, 90))) + " ß" for _ in range(60)]
    texts += ["".join(r.choice("0123456789ABCDEF") for _ in range(r.randrange(15, 40))) for _ in range(20)]
    texts += [" ".join("".join(r.choice("abcdef0123456789") for _ in range(30)) for _ in range(1200))]  # more hits than a block
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = secrets.scan_secrets(df, into="s", base_into="f").select(
        "doc_id", *[F.transform(c, lambda x: F.array(x["start"], x["order"].cast("long"), x["end"])).alias(c) for c in ("f", "s")]).collect()
    some = 0
    for row in got:
        fixed, every = expected(texts[row.doc_id] or "")
        assert [tuple(x) for x in row.f] == fixed, texts[row.doc_id]
        assert [tuple(x) for x in row.s] == every, texts[row.doc_id]
        some += len(every) > len(fixed)
    assert some > 30


def test_masking(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in secrets.mask_secrets(df).collect()}
    assert got[0] is None and got[1] == ""
    assert got[2] == "[SECRET] secret=token :abcdefgh"
    assert got[4] == TEXTS[4] and got[10] == TEXTS[10]
    assert got[3] == "é" * 5 + '[SECRET]" [SECRET] \U0001f600 [SECRET]'


def test_no_python_and_no_shuffle(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = secrets.scan_secrets(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_the_allow_list_takes_out_only_what_it_names(spark):
    key = "q7Zk2Xw9Lm4Rt8Vb1Ny6Hc3Jd5Pf0Gs+Ta-Ue_Wo"
    hidden = [
        f"example-app-id=1{key}", f"xxxxxxxx/1{key}", f"0123456789={key}", f"https://deploy:{key}@git.host/x", f"https://h.host/services/T0/B0/{key}",
        f"https://h.host/f?sig={key}", f"https://h.host/f#{key}", "sha256:" + "ab12" * 16 + f"/{key}"]
    plain = ["https://h.host/a1/b2/c3/d4/e5/f6/g7/h8/i9", "sha256:" + "0A1b2C3d" * 8, "sha512-" + "A" * 20, "abcdefghijklmnopqrstuvwxyz0123456789", "img;base64," + key]
    df = spark.createDataFrame(list(enumerate(hidden + plain)), "doc_id long, text string")
    got = [r.text for r in secrets.mask_secrets(df).orderBy("doc_id").collect()]
    for text, masked in zip(hidden, got):
        assert secrets.MASK in masked and key[8:-8] not in masked, text
    assert got[len(hidden):] == plain
    assert got[3] == f"https://deploy:{secrets.MASK}@git.host/x"


def test_an_address_is_known_however_long_it_is(spark):
    folders = "Reports2019/QuickB3Summary/TeamJ7Budget"
    key = "k9Zq8Xw7Vu6Ts5Rp4Qn3Lm2"
    texts = [
        f"https://ex.org/{folders}", f"https://ex.org/{'a.b/' * 40}{folders}", f"https://ex.org/{key}.x/{folders}", f"see https://localhost/{folders}",
        f"https://ex.org/?q=1;{'c.' * 50}{folders}", f"https://ex.org/ {folders}", f"https://ex.org/{folders}?key={key}", folders,
        " ".join(f"https://ex.org/{i}/{folders}" for i in range(300)) + f" {folders}", f"https://ex.org/a {folders} https://ex.org/b",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [[r.text[s.start:s.end] for s in r.secrets if s.kind == "entropy_base64"]
           for r in secrets.scan_secrets(df).orderBy("doc_id").collect()]
    # No span in paths, whatever stands before; one elsewhere, and the key in each place where it stands.
    alone = got[7]
    assert len(alone) == 1
    assert got == [[], [], [key], [], alone, alone, [got[6][0]], alone, alone, alone] and key in got[6][0]

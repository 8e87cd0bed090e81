"""Operators on texts against plain Python versions, with nulls, empty and long texts, repeated rows, clashing columns and empty tables."""

import datetime
import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from usagemill.llm import cotrain, langid, packing, piece_codec, pii, quality_rules, secrets, url_filter

SPACE = "[^\x20\x09-\x0d]+"
AWKWARD = [
    None, "", " \t\n", "word", "a\x0bb\x0cc\rd", "same line\nsame line\n\nother\nsame line", "x y z " * 30, "\u00e9\u00df \u65e5\u672c\u8a9e \U0001f600 text", 'password = "hunter2hunter2" token:abc',
    "TOKEN='" + "A1b2" * 5 + "' AKIA" + "Z" * 20 + " " + "0123456789abcdef" * 3, "token=secret=abcdefghijklmnop secret: qrstuvwxyz012345", "#*$%&|<>!" * 9, "long " * 30_000, "nospace" * 9_000,
]


def frame(spark, texts, extra=True):
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 7 == 0 else f"s{i % 2}", 0 if t is None else len(t), "mine", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _pieces0 string, _score0 int")
    return df if extra else df.drop("_pieces0", "_score0")


def random_texts(n, seed=1):
    rng = random.Random(seed)
    return [" ".join(rng.choice(["alpha", "beta", "gamma,", "x", "the\n", "#a", "B!"]) for _ in range(rng.randint(0, 120))) for _ in range(n)]


# ---- quality rules


def plain_counts(text):
    text = text or ""
    words, places = re.findall(SPACE, text), {}
    for i in range(len(words) - 2):
        places.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {p + k for v in places.values() if len(v) > 1 for p in v for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(SPACE, x)]
    n, rep = len(words), len(covered)
    return n, sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), rep, n < 50 or 100 * rep > 50 * n


def test_rules_count_like_plain_python(spark):
    texts = AWKWARD + random_texts(60)
    got = {r.doc_id: r for r in quality_rules.rules(frame(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r._q_n_words, r._q_word_chars, r._q_n_symbols, r._q_n_dup_lines, r._q_n_repeat_words, r._q_base_failed) == plain_counts(t), t and t[:60]
        assert not (r._q_base_failed and r._q_kept)


def test_rules_keep_columns_and_multiplicity(spark):
    docs = frame(spark, [" ".join(f"w{i}x{k}" for k in range(80)) for i in range(10)])
    kept = quality_rules.kept(docs.unionByName(docs.limit(1)))
    assert kept.columns == docs.columns and kept.count() == 11
    assert quality_rules.kept(docs.where("false")).count() == 0


def test_rules_fences_follow_their_group(spark):
    clean = [" ".join(f"w{i}x{k}" for k in range(80)) for i in range(300)]
    noisy = [" ".join(f"w{i}x{k}##" for k in range(80)) for i in range(300)]
    df = spark.createDataFrame([(i, t, "en", "a") for i, t in enumerate(clean)] + [(1000, noisy[0], "en", "a")] + [(2000 + i, t, "en", "b") for i, t in enumerate(noisy)], "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in quality_rules.kept(df).collect()}
    assert 1000 not in kept and all(i in kept for i in range(300)) and all(2000 + i in kept for i in range(300))


def test_bins_rise_without_an_end(spark):
    values = [*range(0, 5000, 7), 2047, 2048, 4095, 4096, 10**6, 10**6 + 1000, 10**12]
    got = [r.b for r in spark.createDataFrame([(v,) for v in sorted(values)], "v long").select(quality_rules._bin(F.col("v")).alias("b")).collect()]
    assert got == sorted(got) and got[: 2048 // 7] == sorted(values)[: 2048 // 7] and len(set(got[-4:])) == 4


def test_long_words_are_told_apart(spark):
    """A group of mean lengths far beyond the exact bins still has a fence that longer words exceed."""
    rows = [(i, " ".join(["x" * 300] * 59 + [f"{i}w{k}" for k in range(1)]), "en", "a") for i in range(200)]
    odd = [(900, " ".join(f"{'y' * 5000}{k}" for k in range(60)), "en", "a")]
    got = {r.doc_id: r._q_broken for r in quality_rules.rules(spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, source string")).collect()}
    metric = list(quality_rules.METRICS).index("word_length")
    assert metric in got[900] and all(metric not in got[i] for i in range(200))


# ---- secrets


def plain_secrets(text):
    out = []
    patterns = ((r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12), ("AKIA[A-Z0-9]+", 0, 18), ("[0-9a-f]+", 0, 16))
    for k, (p, g, n) in enumerate(patterns):
        out += [(m.start(), k, m.end()) for m in re.finditer(p, text or "", re.A) if len(m.group(g)) >= n]
    return sorted(out)


def test_secrets_equal_plain_python(spark):
    rng = random.Random(3)
    bits = ["token", "=", ": ", '"', "AKIA", "ABCDEFGH12", "deadbeef", "0123", " ", "x", "password", "api_key", "\n", "é"]
    texts = AWKWARD + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(150)]
    docs = frame(spark, texts)
    got = secrets.scan(docs.unionByName(docs.where("doc_id = 9"))).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        assert [(x.s, x.k, x.e) for x in r.base] == plain_secrets(texts[r.doc_id])
        assert {(x.s, x.k, x.e) for x in r.base} <= {(x.s, x.k, x.e) for x in r.spans}
    assert secrets.scan(docs.where("false")).count() == 0


def test_weak_parts_are_told_only_together(spark):
    texts = ["password = short1", "user = alice1 password = short1", "https://db.example.com/x", "https://db.example.com/x user: bob12 passwd: q1w2e3", "user = alice1" + " pad" * 100 + " password = short1"]
    got = {r.doc_id: {secrets.KINDS[x.k] for x in r.spans} for r in secrets.scan(frame(spark, texts)).collect()}
    assert got == {0: set(), 1: {"account", "weak_secret"}, 2: set(), 3: {"account", "weak_secret", "endpoint"}, 4: set()}


# ---- pseudonyms

VALUES = ["a.Bc9@mail.example.com", "4539578763621486", "4539 5787 6362 1486", "4539578763621487", "1.2.3.4", "300.2.3.4", "2024-02-29", "2023-02-29", "31.12.1999", "02/28/2001", "+1 (017) 555-7713", "123-45-6789", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "GB83WEST12345698765432"]
INVALID = {"4539578763621487", "300.2.3.4", "2023-02-29", "GB83WEST12345698765432"}


def luhn(s):
    d = [int(c) for c in re.sub(r"\D", "", s)][::-1]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


def shape(s):
    return re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", s)))


def test_pseudonyms_keep_format_validity_and_links(spark):
    texts = [*VALUES, "first " + VALUES[0] + " then " + VALUES[6] + ".", None, "", "nothing here"]
    got = [r.text for r in pii.pseudonymised(frame(spark, texts), "key").orderBy("doc_id").collect()]
    for old, new in zip(VALUES, got, strict=False):
        assert (old == new) == (old in INVALID), old
        if old != "1.2.3.4":
            assert shape(old) == shape(new)
    assert luhn(got[1]) and luhn(got[2]) and re.sub(" ", "", got[2]) == got[1]
    assert all(int(x) < 256 for x in got[4].split("."))
    datetime.date.fromisoformat(got[6])
    assert got[len(VALUES)] == f"first {got[0]} then {got[6]}."
    assert got[-3:] == [None, "", "nothing here"]
    other = [r.text for r in pii.pseudonymised(frame(spark, texts), "other key").orderBy("doc_id").collect()]
    assert other[1] != got[1]


def test_pseudonyms_do_not_depend_on_neighbours(spark):
    card, phone, iban = VALUES[1], VALUES[10], VALUES[12]
    texts = [card, phone, iban, f"12 {card} 34", f"{card} {card}", f"{phone} 12 {phone}", f"x {iban} WORD", f"4539578763621487 {card}"]
    a, b, c, *rest = (r.text for r in pii.pseudonymised(frame(spark, texts), "k").orderBy("doc_id").collect())
    assert rest == [f"12 {a} 34", f"{a} {a}", f"{b} 12 {b}", f"x {c} WORD", f"4539578763621487 {a}"]


def test_spaced_values_beside_short_numbers(spark):
    values = ["4539 5787 6362 1486", "4539-5787-6362-1486", "3782 822463 10005", "4539578763621486", "AT61 1904 3002 3457 3201", "NO93 8601 1117 947", "DE89 3704 0044 0532 0130 00", "GB29 NWBK 6016 1331 9268 19"]
    sides = ["7", "12", "124", "2024", "12 2024"]  # the first card with 123 behind it is a valid longer one
    around = ["{}", *[f"{x} {{}}" for x in sides], *[f"{{}} {x}" for x in sides], *[f"{x} {{}} {x}" for x in sides], "in 2024 {} 12/27", "{} 12.05.2024", "{} WORD", "{} 2024 {} 7"]
    texts = [a.replace("{}", v) for v in values for a in around] + [f"{v} {w}" for v in values for w in values]
    got = [r.text for r in pii.pseudonymised(frame(spark, texts), "k").orderBy("doc_id").collect()]
    new = dict(zip(values, got[:: len(around)], strict=False))
    assert all(new[v] != v for v in values)
    other = pii.pseudonymised(spark.createDataFrame([("12.05.2024",)], "text string"), "k").first().text
    for old, out in zip(texts[: -len(values) ** 2], got, strict=False):
        expected = old
        for v in values:
            expected = expected.replace(v, new[v])
        assert out == expected.replace("12.05.2024", other), old
    assert got[-len(values) ** 2 :] == [f"{new[v]} {new[w]}" for v in values for w in values]


def test_values_beside_values_of_other_formats(spark):
    card, others = "4539 5787 6362 1486", ["555-12-3456", "1999-02-03", "12@example.com", "192.168.1.77", "555-123-4567"]
    alone = [card, *others]
    texts = alone + [f"{card} {x} {card}" for x in others] + ["1 2 3 " * 5000 + card]
    rows = pii.pseudonymised(frame(spark, texts), "k", count="n").orderBy("doc_id").collect()
    new = [r.text for r in rows]
    assert new[6:11] == [f"{new[0]} {x} {new[0]}" for x in new[1:6]] and new[11] == "1 2 3 " * 5000 + new[0]
    assert [r.n for r in rows] == [1] * 6 + [3] * 5 + [1]


def test_pseudonyms_are_permutations(spark):
    days = spark.range(3000).select(F.date_format(F.date_add(F.lit("1999-01-01"), F.col("id").cast("int")), "yyyy-MM-dd").alias("text"))
    assert pii.pseudonymised(days, "k").distinct().count() == 3000
    numbers = spark.range(1000).select(F.concat(F.lit("555-01-"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("text"))
    assert pii.pseudonymised(numbers, "k").distinct().count() == 1000


def plain_hash(key, *what):
    return hashlib.sha256("|".join([key, *map(str, what)]).encode()).hexdigest()


def plain_number(value, left, right, key):
    a, b = divmod(value, right)
    for i in range(pii.ROUNDS):
        noise = int(plain_hash(key, i, a if i % 2 else b)[:15], 16)
        a, b = (a, (b + noise) % right) if i % 2 else ((a + noise) % left, b)
    return a * right + b


def plain_text(value, key):
    def shifted(half, seed):
        out = ""
        for i, c in enumerate(half):
            noise = seed if i < 32 else hashlib.sha256(f"{seed}|{i // 32}".encode()).hexdigest()
            n = int(noise[i % 32 * 2 :][:2], 16)
            out += next((chr((ord(c) - ord(f) + n) % k + ord(f)) for f, k in (("0", 10), ("a", 26), ("A", 26)) if ord(f) <= ord(c) < ord(f) + k), c)
        return out

    middle = -(-len(value) // 2)
    a, b = value[:middle], value[middle:]
    for i in range(pii.ROUNDS):
        a, b = (a, shifted(b, plain_hash(key, i, a))) if i % 2 else (shifted(a, plain_hash(key, i, b)), b)
    return a + b


def plain_fill(form, values, digits=True):
    rest = iter(values)
    return "".join(next(rest) if (c.isdigit() if digits else c != " ") else c for c in form)


def plain_check(body, country):
    number = "".join(str(int(c, 36)) for c in body + country + "00")
    return f"{98 - int(number) % 97:02d}"


def plain_day(d, key):
    first = datetime.date(1600, 1, 1).toordinal()
    block, at = divmod(d.toordinal() - first, 146097)
    day = lambda x: datetime.date.fromordinal(first + x).day <= 12
    new = plain_number(at, 189, 773, key)
    while day(new) != day(at):
        new = plain_number(new, 189, 773, key)
    return datetime.date.fromordinal(first + block * 146097 + new)


def plain_pseudonym(kind, m, key):
    """A valid value of a kind, permuted by other means than the operator's."""
    key += kind
    if kind == "email":
        name, domain = m.split("@")
        return "".join(n.upper() if o.isupper() else n for o, n in zip(name, plain_text(name.lower(), key), strict=True)) + "@" + domain
    if kind == "iban":
        body = plain_text(m.replace(" ", "")[4:], key)
        return plain_fill(m, m[:2] + plain_check(body, m[:2]) + body, digits=False)
    if kind == "card":
        body = plain_text(re.sub("[^0-9]", "", m)[:-1], key)
        return plain_fill(m, next(body + str(d) for d in range(10) if luhn(body + str(d))))
    if kind == "address":
        a, b, c, d = map(int, m.split("."))
        new = plain_number(a << 24 | b << 16 | c << 8 | d, 65536, 65536, key)
        return ".".join(str(new >> s & 255) for s in (24, 16, 8, 0))
    if kind == "social":
        a, b, c = map(int, m.split("-"))
        rest, c = divmod(plain_number(((a - 1 - (a > 666)) * 99 + b - 1) * 9999 + c - 1, 898 * 99, 9999, key), 9999)
        a, b = divmod(rest, 99)
        return f"{a + 1 + (a + 1 >= 666):03d}-{b + 1:02d}-{c + 1:04d}"
    if kind == "phone":
        code = (re.match(r"\+[0-9]{1,3}(?=[^0-9])|\+[0-9]", m) or [""])[0]
        return code + plain_fill(m[len(code) :], plain_text(re.sub("[^0-9]", "", m[len(code) :]), key))
    for form in ("%Y-%m-%d", "%d.%m.%Y", "%m/%d/%Y", "%d/%m/%Y"):
        try:
            return plain_day(datetime.datetime.strptime(m, form).date(), key).strftime(form)
        except ValueError:
            continue


def test_pseudonyms_equal_plain_python(spark):
    values = {
        "email": [VALUES[0], "x@y.org", "Anna.Lee+x@z.net", "ab1." * 60 + "end@long.example.com"],
        "iban": ["DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "GB82WEST12345698765432", "NO93 8601 1117 947"],
        "card": ["4539578763621486", "4539 5787 6362 1486", "3782-822463-10005"],
        "address": ["1.2.3.4", "255.255.255.255"],
        "social": ["123-45-6789", "001-01-0001", "665-99-9999", "667-10-0100", "899-99-9999"],
        "phone": ["+1 (017) 555-7713", "555-123-4567", "+49 170 1234567", "(555) 123-4567"],
        "date": ["2024-02-29", "1999-12-31", "31.12.1999", "02/28/2001", "28/02/2001", "02/03/2001", "03.02.2001", "2001-02-03"],
    }
    rows = [(k, v) for k, own in values.items() for v in own]
    got = [r.text for r in pii.pseudonymised(spark.createDataFrame([(i, v) for i, (_, v) in enumerate(rows)], "i int, text string"), "key").orderBy("i").collect()]
    for (kind, v), new in zip(rows, got, strict=True):
        assert new == plain_pseudonym(kind, v, "key") != v, (kind, v)


def test_equal_values_stay_equal_however_written(spark):
    pairs = [("DE89 3704 0044 0532 0130 00", "DE89370400440532013000"), ("4539 5787 6362 1486", "4539578763621486"), ("Ann.Lee@x.org", "ann.lee@x.org")]
    days = ["2001-02-28", "28.02.2001", "02/28/2001", "28/02/2001"]
    bad = ["000-12-3456", "666-12-3456", "912-12-3456", "123-00-3456", "123-45-0000", "31/02/2001", "13/13/2001", "+49 1234 5678 9012 3456 7890"]
    texts = [v for p in pairs for v in p] + days + bad
    got = [r.text for r in pii.pseudonymised(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), "k").orderBy("i").collect()]
    for i in range(0, 2 * len(pairs), 2):
        assert got[i].replace(" ", "").lower() == got[i + 1].lower() != texts[i + 1].lower()
    at = 2 * len(pairs)
    read = [datetime.datetime.strptime(v, f).date() for v, f in zip(got[at : at + 4], ("%Y-%m-%d", "%d.%m.%Y", "%m/%d/%Y", "%d/%m/%Y"), strict=True)]
    assert len(set(read)) == 1 and read[0].day > 12
    assert got[at + 4 :] == bad


def test_slash_dates_are_a_permutation(spark):
    days = spark.range(1500).select(F.date_add(F.lit("1999-01-01"), F.col("id").cast("int")).alias("d"))
    texts = days.select(F.explode(F.array(F.date_format("d", "MM/dd/yyyy"), F.date_format("d", "dd/MM/yyyy"))).alias("text")).distinct()
    assert pii.pseudonymised(texts, "k").distinct().count() == texts.count()


def test_pseudonyms_leave_columns_alone(spark):
    docs = frame(spark, ["mail a@b.co"] * 2)
    out = pii.pseudonymised(docs, "k", count="n")
    assert out.columns == [*docs.columns, "n"] and {r._pieces0 for r in out.collect()} == {"mine"} and {r.n for r in out.collect()} == {1}
    assert pii.pseudonymised(docs.where("false"), "k").count() == 0


# ---- classifier


def test_classifier_learns_from_few_labels_and_scores_all(spark):
    good = ["Plain words make a sentence that goes on, number %d, and stops." % i for i in range(150)]
    bad = ["BUY!! NOW!! CHEAP!! %d!! " % i * 6 for i in range(150)]
    docs = frame(spark, good + bad + [None, ""]).withColumn("n_chars", F.length("text").cast("long"))
    labels = docs.where("doc_id % 3 = 0 AND doc_id < 300").select("doc_id", (F.col("doc_id") < 150).cast("int").alias("quality"))
    views = cotrain.train(docs, labels.unionByName(labels.limit(3)))
    got = {r.doc_id: r.score for r in cotrain.scored(docs, views).collect()}
    assert len(got) == 302
    assert sum((s > 0.5) == (i < 150) for i, s in got.items() if i < 300) > 295
    kept = cotrain.kept(docs, labels)
    assert kept.columns == docs.columns


def plain_cotraining(rows, labels, rounds, share):
    """Scores by doc_id: the same leaf functions, but all else by lists, sorting and loops."""
    import struct

    import xxhash

    half = lambda t: cotrain.text_features(t).astype(np.float16).astype(np.float32)
    x = {d: (half(t), cotrain.meta_features([lang], [source], [n])[0]) for d, t, lang, source, n in rows}
    order = sorted(labels, key=lambda d: struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(struct.pack("<q", d), 42)))[0])
    held, fit = order[::4], [d for i, d in enumerate(order) if i % 4]
    own = [[(x[d][v], labels[d], 1.0) for d in fit] for v in (0, 1)]
    good = sum(labels[d] for d in fit) / len(fit)
    wanted = [max(1, round(share * len(fit) * c)) for c in (1 - good, good)]
    truth = np.array([labels[d] for d in held], float)

    def fitted(v, rows_of):
        w = cotrain.fit_logistic(np.stack([r[0] for r in rows_of]), np.array([r[1] for r in rows_of], float), weight=np.array([r[2] for r in rows_of]))
        z = np.clip(np.stack([x[d][v] for d in held]) @ w, -12, 12)
        scale = cotrain.fit_logistic(np.stack([z, np.ones_like(z)], 1), truth, 1e-2)
        odds = lambda d: float(np.clip(x[d][v] @ w * scale[0] + scale[1], -12, 12))
        return odds, cotrain.loss(np.array([odds(d) for d in held]), truth)

    heard, gone, log = [True, True], set(), []
    for n in range(rounds + 1):
        views = [fitted(v, own[v]) for v in (0, 1)]
        if n == rounds:
            break
        handed = {}
        for by in (0, 1):
            middle = np.quantile([views[by][0](d) for d in held], 1 - good)
            sure = {d: views[by][0](d) - middle for d in x if d not in labels and d not in gone}
            for y in (0, 1):
                for d in sorted((d for d, o in sure.items() if (o > 0) == y), key=lambda d: (-abs(sure[d]), d))[: wanted[y]]:
                    handed.setdefault(d, (by, y))
        for by in (0, 1):
            more = [(x[d][1 - by], float(y), cotrain.PSEUDO_WEIGHT) for d, (b, y) in handed.items() if b == by]
            if more and heard[by] and fitted(1 - by, own[1 - by] + more)[1] <= views[1 - by][1] + cotrain.TOLERANCE:
                own[1 - by] += more
            elif more:
                heard[by] = False
        gone |= handed.keys()
        log.append([sorted(d for d, (b, _) in handed.items() if b == by) for by in (0, 1)])
    columns = np.stack([[views[0][0](d) for d in held], [views[1][0](d) for d in held], np.ones(len(held))], 1)
    both = cotrain.fit_logistic(columns, truth, 1e-1)
    if (both[:2] >= 0).all():
        return {d: 1 / (1 + np.exp(-(both @ [views[0][0](d), views[1][0](d), 1]))) for d in x}, log
    return None, log


def test_classifier_equals_plain_cotraining(spark):
    rng = random.Random(11)
    rows = []
    for i in range(240):
        good = rng.random() < 0.6
        text = " ".join(rng.choice(["plain", "words", "make", "sense"] if good or rng.random() < 0.5 else ["BUY!!", "now", "$$$", "sense"]) for _ in range(30))
        rows.append((i, text, rng.choice(["en", "de"]), "s1" if good == (rng.random() < 0.8) else "s2", len(text), int(good)))
    docs = spark.createDataFrame([r[:5] for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    labels = {r[0]: r[5] for r in rows if r[0] % 2}
    frame_ = spark.createDataFrame(list(labels.items()), "doc_id long, quality int")
    views = cotrain.train(docs, frame_, rounds=2, pick_share=0.1)
    expected, log = plain_cotraining([r[:5] for r in rows], labels, 2, 0.1)
    assert [[sorted(p) for p in r["picked"]] for r in views.rounds] == log
    assert all(p for r in log for p in r) and not set(sum(log[0], [])) & set(sum(log[1], []))
    assert any(any(r["heard"]) for r in views.rounds) and expected is not None
    got = {r.doc_id: r.score for r in cotrain.scored(docs, views).collect()}
    assert all(abs(got[d] - s) < 1e-4 for d, s in expected.items())
    again = {r.doc_id: r.score for r in cotrain.judged(docs.withColumn("score", F.lit("old")), frame_, rounds=2, pick_share=0.1).collect()}
    assert all(abs(got[d] - again[d]) < 1e-9 for d in got)


def test_both_views_hand_over_new_documents_and_text_gains_nothing_false():
    """Held-out figures over the test tables; they are stated in README."""
    import os

    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    from pyspark.sql import SparkSession

    session = SparkSession.getActiveSession()
    docs, labels = (session.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    pool = cotrain.featured(docs.select("doc_id", "text", *cotrain.META), texts=False)
    held = pool.join(labels.where("doc_id % 3 = 0").select("doc_id", "quality"), "doc_id").toPandas()
    y = held["quality"].to_numpy()

    def area(s):
        return np.mean([(a > b) + (a == b) / 2 for a in s[y == 1] for b in s[y == 0]])

    found = {}
    for rounds in (0, 2):
        views = cotrain.train_on(pool, labels.where("doc_id % 3 <> 0"), rounds=rounds)
        text, meta = views.odds(*cotrain._arrays(held))
        found[rounds] = area(text), area(meta), area(views.scores(*cotrain._arrays(held)))
    assert len(views.rounds) == 2 and all(len(p) for r in views.rounds for p in r["picked"])
    assert len({d for r in views.rounds for p in r["picked"] for d in p}) == sum(len(p) for r in views.rounds for p in r["picked"])
    assert found[2][0] > 0.97 and found[2][2] > 0.97 and found[2][0] >= found[0][0] - 0.01 and found[2][1] >= found[0][1] - 0.05, found


def test_classifier_without_labels_keeps_all(spark):
    docs = frame(spark, AWKWARD[:8])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert cotrain.kept(docs, none).count() == 8
    assert cotrain.kept(docs.where("false"), none).count() == 0


# ---- piece codec


@pytest.fixture(scope="module")
def library():
    sentencepiece = pytest.importorskip("sentencepiece")
    return sentencepiece.SentencePieceProcessor(model_file=piece_codec.model_path())


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab the▁ \n\tédß日本é①😀\x00​0123<>/"), st.characters(codec="utf-8")), max_size=120))
def test_codec_equals_library(library, text):
    ((raw, decimal),) = piece_codec.pieces(piece_codec.model_path()).encode([text])
    ids = np.frombuffer(raw, "<i4").tolist()
    assert ids == library.encode(text) and decimal == ",".join(map(str, ids))
    assert piece_codec.pieces(piece_codec.model_path()).decode(np.array(ids, int)) == library.decode(ids)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 31999)), max_size=25))
def test_decoding_any_ids_equals_library(library, ids):
    assert piece_codec.pieces(piece_codec.model_path()).decode(np.array(ids, int)) == library.decode(ids)


def test_codec_long_runs_and_frames(spark, library):
    rng = random.Random(2)
    runs = ["".join(rng.choice(signs) for _ in range(4000)) for signs in ("abcdefghijklmnopqrstuvwxyz", "eeettaaoin", "ab ", "=-", "日本語a")]
    texts = [*AWKWARD, "a" * 50_000, "ab" * 30_000, " " * 70_001, "=" * 9001 + "-" * 9001, *runs]
    out = piece_codec.decoded(piece_codec.encoded(frame(spark, texts), piece_codec.model_path()), piece_codec.model_path(), text="again").collect()
    for r in out:
        assert list(r.ids) == library.encode(texts[r.doc_id] or "") and r.again == library.decode(list(r.ids))
    digest = {r.doc_id: r for r in piece_codec.digests(frame(spark, texts), piece_codec.model_path()).collect()}
    assert digest[0].ids_sha256 == digest[1].decoded_sha256 == hashlib.sha256(b"").hexdigest() and digest[0].n_tokens == 0
    assert piece_codec.digests(frame(spark, texts).where("false"), piece_codec.model_path()).count() == 0


# ---- languages


def test_languages(spark):
    words = {"en": "the and thing with that from", "de": "der und nicht schön über für", "fr": "le été être déjà avec dans"}
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(words[lang].split()) for _ in range(30)), lang) for i, lang in enumerate(list(words) * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    centroids = langid.learn(docs.where("doc_id % 2 = 0"))
    probe = docs.unionByName(spark.createDataFrame([(900, None, None), (901, "", None), (902, "123 !!", None), (None, "the and with", None)], docs.schema))
    with pytest.raises(ValueError):
        langid.identified(probe.withColumn("Score", F.lit(1)), centroids)
    clash = langid.identified(probe.withColumns({"score": F.lit("mine"), "_lang0": F.lit(1)}), centroids, names=("guess", "cosine", "near"))
    assert clash.columns == ["doc_id", "text", "lang", "score", "_lang0", "guess", "cosine", "near"] and {r.score for r in clash.collect()} == {"mine"}
    got = langid.identified(probe, centroids).collect()
    assert all(r.lang_pred == r.lang for r in got if r.lang)
    assert all((r.lang_pred, r.score) == ("und", 0) for r in got if r.doc_id in (900, 901, 902))
    assert all(0 <= r.score <= 1 for r in got)
    nothing = langid.learn(docs.where("false"))
    assert {r.lang_pred for r in langid.identified(docs, nothing).collect()} == {"und"}


def test_nearest_centroid_equals_plain_cosine(spark):
    rng = random.Random(6)
    words = {"en": "the and thing with that from", "de": "der und nicht schön über für"}
    rows = [(i, " ".join(rng.choice(words[lang].split()) for _ in range(12)), lang) for i, lang in enumerate(["en", "de"] * 30)]
    centroids = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))

    def grams(text):
        body = b" " + b" ".join("".join(c if c.isalpha() or ord(c) > 127 else " " for c in text.lower()).encode().split()) + b" "
        slot = lambda x: (x * 2654435761 & 0xFFFFFFFF) >> 20
        two = [body[i] * 257 + body[i + 1] for i in range(len(body) - 1)]
        return [slot(x) for x in two] + [slot(two[i] * 263 + body[i + 2] + (1 << 20)) for i in range(len(two) - 1)]

    def vector(text):
        n = np.bincount(grams(text), minlength=langid.DIMENSIONS)
        v = np.log1p(n) * centroids.idf
        return v / np.sqrt((v**2).sum())

    found = np.array([[s in set(grams(t)) for s in range(langid.DIMENSIONS)] for _, t, _ in rows]).sum(0)
    assert np.allclose(centroids.idf, np.log((1 + len(rows)) / (1 + found)) + 0.05, atol=1e-5)
    for text in ["the thing über", "der und das", "from that", "schön"]:
        cosine = [float(vector(text) @ c) for c in centroids.centres]
        (lang,), (score,), _ = centroids.nearest([text])
        assert lang == centroids.langs[int(np.argmax(cosine))] and abs(score - max(cosine)) < 1e-4


def test_held_out_languages_of_the_test_tables(spark):
    import os

    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("no test tables")
    got = langid.op7_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    right = got.where("held_out AND lang IS NOT NULL").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.98


# ---- urls


def test_url_parts_and_rules(spark):
    rows = ["HTTP://Www.A.net/x?q#f", "https://example.net/en/1", "https://notexample.net/en", "http://x.example.com/de/", "http://o.org/fr/a/b#z", "http://o.org?x", "no scheme", None, "", "x://", "http://sub.net", "http://free-casino.example.org/es/1"]
    pages = spark.createDataFrame([(i, u, "<title>free casino sub</title>" if u else None, "?") for i, u in enumerate(rows)], "page_id long, url string, html string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judged(pages).collect()}
    assert got[0] == ("www.a.net", "/x", "net/", "block")
    assert got[1] == ("example.net", "/en/1", "example.net/en/", "allow")
    assert got[2][:3] == ("notexample.net", "/en", "net/")
    assert got[3][2:] == ("example.com/de/", "block") and got[4] == ("o.org", "/fr/a/b", "org/fr/", "allow")
    assert got[5][:3] == ("o.org", "", None) and got[10][:3] == ("sub.net", "", None)
    assert all(got[i][:3] == ("", "", None) for i in (6, 7, 8, 9))
    assert url_filter.judged(pages.where("false")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab", min_size=1, max_size=9), st.dictionaries(st.text(alphabet="ab", min_size=1, max_size=4), st.integers(1, 50), max_size=8))
def test_viterbi_finds_the_cheapest_split(name, words):
    total = sum(words.values())
    cost = lambda w: np.log(total + 1.0) - np.log(words[w]) if w in words else np.log(total + 1.0) + url_filter.UNKNOWN_LETTER * len(w)

    def splits(s):
        return [[s[:k], *rest] for k in range(1, len(s) + 1) for rest in splits(s[k:])] if s else [[]]

    best = min(sum(map(cost, x)) for x in splits(name))
    found = [(i, k, words[name[i : i + k]]) for i in range(len(name)) for k in range(1, len(name) - i + 1) if name[i : i + k] in words]
    assert sum(map(cost, url_filter.split_name(name, found, total))) == pytest.approx(best)


def plain_judgement(pages, rules, rounds):
    """(verdict, log-odds) by page, with dictionaries and loops; host names are split by trying all splits."""
    import zlib

    titles = {i: re.findall(r"[^\W\d_]+", (re.search(r"(?is)<title[^>]*>(.*?)</title>", h or "") or ["", ""])[1].lower()) for i, _, h in pages}
    counts = {}
    for own in titles.values():
        for w in own:
            counts[w] = counts.get(w, 0) + 1
    total = sum(counts.values())
    cost = lambda w: np.log(total + 1.0) - np.log(counts[w]) if w in counts else np.log(total + 1.0) + url_filter.UNKNOWN_LETTER * len(w)

    def splits(s):
        return [[s[:k], *rest] for k in range(1, len(s) + 1) for rest in splits(s[k:])] if s else [[]]

    named = {w for host, path, _ in rules for w in re.findall(r"[^\W\d_]+", host + path)}
    seen = {}
    for i, url, _ in pages:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = host.lower()
        fits = [(len(h + p), v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        words = [w for name in re.findall(r"[^\W\d_]+", host) for w in min(splits(name), key=lambda x: sum(map(cost, x)))]
        words += re.findall(r"[^\W\d_]+|0", re.sub("[0-9]+", "0", path.lower()))
        slot = lambda own: [zlib.crc32(w.encode()) % url_filter.SLOTS for w in own if w not in named]
        seen[i] = (max(fits)[1] if fits else None, slot(words), slot(titles[i]))

    def odds(rows, part):
        n = {}
        for label, own in rows:
            for s in own[part]:
                n.setdefault(s, [0, 0])["block allow".split().index(label)] += 1
        sums = [sum(c[k] for c in n.values()) + url_filter.SMOOTHING * max(len(n), 1) for k in (0, 1)]
        return {s: np.log((c[0] + url_filter.SMOOTHING) / sums[0]) - np.log((c[1] + url_filter.SMOOTHING) / sums[1]) for s, c in n.items()}

    tables = None
    for n in range(rounds + 1):
        rows = []
        for verdict, *own in seen.values():
            label = verdict
            if label is None and n:
                title = sum(tables[1].get(s, 0) for s in own[1]) * min(1, url_filter.TITLE_WORDS / max(len(own[1]), 1))
                both = sum(tables[0].get(s, 0) for s in own[0]) + title
                label = "block" if both >= url_filter.SURE else "allow" if both <= -url_filter.SURE else None
            if label:
                rows.append((label, own))
        tables = [odds(rows, part) for part in (0, 1)]
    out = {i: (v, sum(tables[0].get(s, 0) for s in words)) for i, (v, words, _) in seen.items()}
    return {i: (v or ("block" if o >= url_filter.BLOCK_FROM else "allow"), o) for i, (v, o) in out.items()}


def test_verdicts_equal_plain_naive_bayes(spark):
    rng = random.Random(8)
    good, bad = ["news", "tea", "book"], ["bet", "win", "spin"]
    pages = []
    for i in range(160):
        kind = good if rng.random() < 0.5 else bad
        host = rng.choice(kind) + rng.choice(kind) + rng.choice([".net", ".example.net", ".org", ".com", ".info"])
        path = rng.choice(["/en/", "/fr/", "/x/"]) + rng.choice(kind) + rng.choice(["", "/12", "-" + rng.choice(kind)])
        pages.append((i, f"http://{host}{path}?q=1", f"<title>{' '.join(rng.choice(kind) for _ in range(6))}</title>" if rng.random() < 0.9 else None))
    pages += [(900, None, None), (901, "no scheme", "<title></title>"), (902, "http://" + "q" * 9 + ".com/" + "z" * 30, None)]
    for rounds in (0, 2):
        expected = plain_judgement(pages, url_filter.RULES, rounds)
        got = url_filter.judged(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3), rounds=rounds).collect()
        assert len(got) == len(pages) and {r.verdict for r in got if r.rule is None} == {"block", "allow"}
        for r in got:
            verdict, odds = expected[r.page_id]
            assert abs(r.log_odds - odds) < 1e-3 and (r.verdict == verdict or abs(odds - url_filter.BLOCK_FROM) < 1e-3)


# ---- packing


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab'strevldm é12²¼,!?-_ \n\tÀÿŁſİΣ日"), st.characters(codec="utf-8")), max_size=100))
def test_encoder_equals_library(text):
    own = packing.encoder(packing.tokenizer_path())
    assert np.frombuffer(own.encode([text])[0], own.dtype).tolist() == own.library.encode(text, add_special_tokens=False).ids


def test_texts_take_the_ids_of_distinct_pre_tokens():
    """Texts are cut together, also next to empty ones and those of the library, and every distinct pre-token is looked up once."""
    own, rng = packing.encoder(packing.tokenizer_path()), random.Random(8)
    signs = ["'", "'", "s", "re", "ve", "ll", "d", " ", "\n", "\t", "é", "ß", "²", "1", "!", "À", "ſ", "×", "日", "\xa0", "\xad", "<|endoftext|>"]
    texts = ["", "'", "'s", "x'", *("".join(rng.choice(signs) for _ in range(rng.randrange(24))) for _ in range(3000)), ""]
    expected = [np.array([*x.ids, 2], own.dtype).tobytes() for x in own.library.encode_batch(texts, add_special_tokens=False)]
    assert own.encoded(texts, np.array([2], own.dtype).tobytes()).to_pylist() == expected
    assert own.encode([]) == [] and own.encode(["", ""]) == [b"", b""]
    parts, upto = packing.pre_tokens([b"don't 'tis''s", b"", "a²3 ß".encode()])
    assert parts.to_pylist() == [b"don", b"'t", b"'t", b"is", b"''", b"s", b"a", "²".encode(), b"3", "ß".encode()] and upto.tolist() == [6, 6, 10]
    looked_up, of = [], own._of
    own._of = lambda found: looked_up.append(len(found)) or of(found)
    try:
        own.encode(["one two " * 500] * 20)
    finally:
        del own._of
    assert looked_up == [2]


def test_encoder_of_long_words_equals_library():
    own, rng = packing.encoder(packing.tokenizer_path()), random.Random(2)
    texts = ["a" * 50_000, "nospace" * 3000, "=" * 9001, *["".join(rng.choice(signs) for _ in range(20_000)) for signs in ("abcdefghijklmnopqrstuvwxyz", "eeettaaoin", "xyz'ts")]]
    assert [np.frombuffer(x, own.dtype).tolist() for x in own.encode(texts)] == [own.library.encode(t, add_special_tokens=False).ids for t in texts]


def test_packing_covers_every_id_once(spark):
    import zlib

    texts = AWKWARD + random_texts(80, 9) + ["<|endoftext|> x", "long words " * 9000]
    docs = frame(spark, texts).unionByName(spark.createDataFrame([(None, "no name", None, None, 1, "", 1)], frame(spark, []).schema)).repartition(3)
    own = packing.encoder(packing.tokenizer_path())
    rows = packing.pack_documents(docs, packing.tokenizer_path(), shard_tokens=5000).toPandas()
    ids = {i: own.library.encode(t or "", add_special_tokens=False).ids + [2] for i, t in enumerate(texts)}
    ids[None] = own.library.encode("no name", add_special_tokens=False).ids + [2]
    seen = {k: np.zeros(len(v), int) for k, v in ids.items()}
    for r in rows.itertuples():
        key = None if r.doc_id != r.doc_id else int(r.doc_id)
        part = ids[key][r.start : r.start + r.length]
        seen[key][r.start : r.start + r.length] += 1
        assert r.doc_tokens == len(ids[key]) and len(part) == r.length and zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
    assert all((v == 1).all() for v in seen.values())
    for _, s in rows.sort_values("offset").groupby("sequence_id"):
        assert (s["offset"].to_numpy() == np.concatenate(([0], np.cumsum(s["length"])[:-1]))).all()
        total = s["length"].sum()
        assert total <= 4096 and total & (total - 1) == 0
    assert packing.pack_documents(docs.where("false"), packing.tokenizer_path()).count() == 0


def plain_ranking(documents, used, seed, idf, mean):
    """Unused documents by BM25 with a seed's tokens as the query, best first."""
    scores = {}
    for i, own in enumerate(documents):
        common = set(own.tolist()) & set(documents[seed].tolist())
        if i not in used and common:
            tf = {t: own.tolist().count(t) for t in common}
            scores[i] = sum(idf[t] * n * (packing.K1 + 1) / (n + packing.K1 * (1 - packing.B + packing.B * len(own) / mean)) for t, n in tf.items())
    return sorted(scores, key=lambda i: (-scores[i], i)), scores


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 40))
def test_retrieval_equals_brute_force_bm25(seed, n):
    rng = np.random.default_rng(seed)
    documents = [rng.integers(0, 60, rng.integers(1, 50)).astype("<u2") for _ in range(n)]
    counts = np.bincount(np.concatenate([np.unique(d) for d in documents]), minlength=60)
    idf, mean = np.log1p((n - counts + 0.5) / (counts + 0.5)).astype(np.float32), float(np.mean([len(d) for d in documents]))
    shard, used = packing.Shard(documents, idf, mean), set()
    for i in rng.permutation(n).tolist():
        expected, scores = plain_ranking(documents, used | {i}, i, idf, mean)
        shard.use(i)
        used.add(i)
        got = shard.neighbours(i).tolist()
        assert set(got) == set(expected)
        assert all(scores[a] >= scores[b] - 1e-4 for a, b in zip(got, got[1:], strict=False))


def test_packing_order_equals_plain_greedy():
    rng = np.random.default_rng(3)
    topics = [rng.integers(t * 100, t * 100 + 100, int(rng.integers(60, 300))) for t in range(6) for _ in range(12)]
    documents = [topics[i] for i in rng.permutation(len(topics))]
    counts = np.bincount(np.concatenate([np.unique(d) for d in documents]), minlength=600)
    idf, mean = np.log1p((len(documents) - counts + 0.5) / (counts + 0.5)).astype(np.float32), float(np.mean([len(d) for d in documents]))
    expected, used, seed, room = [], set(), -1, 1000
    while len(expected) < len(documents):
        if seed < 0:
            seed = min(set(range(len(documents))) - used)
            expected.append(seed)
            used.add(seed)
            room -= len(documents[seed])
        room = room if room > 0 else room % packing.WINDOW or packing.WINDOW
        own, seed = seed, -1
        for i in plain_ranking(documents, used, own, idf, mean)[0]:
            expected.append(i)
            used.add(i)
            room -= len(documents[i])
            if room <= 0:
                seed = i
                break
    assert list(packing._order(documents, idf, mean, 1000)) == expected
    topic = [int(documents[i][0]) // 100 for i in expected]
    assert sum(a == b for a, b in zip(topic, topic[1:], strict=False)) >= len(topic) - 12  # a topic is left only when it is used up or a window ends


def test_packing_does_not_depend_on_partitions(spark):
    rng = random.Random(4)
    topics = [" ".join(f"{rng.choice('bcdfgklmnprst')}{rng.choice('aeiou')}{rng.choice('bdgkmnprt')}{rng.choice('aeiou')}" for _ in range(40)).split() for _ in range(12)]
    docs = [(100 * i + t, " ".join(rng.choice(topics[t]) for _ in range(150))) for i in range(20) for t in range(12)]  # topics take turns
    df = spark.createDataFrame(docs, "doc_id long, text string")
    one, many = (packing.pack_documents(df.repartition(n, "doc_id"), packing.tokenizer_path(), shard_tokens=30_000).toPandas() for n in (1, 40))
    columns = ["sequence_id", "offset", "doc_id", "start", "length"]
    assert sorted(map(tuple, one[columns].values.tolist())) == sorted(map(tuple, many[columns].values.tolist()))
    sizes = many.groupby("sequence_id")["length"].sum()
    assert (sizes < 4096).sum() <= 12  # the ends of all shards are packed together
    own = many.assign(topic=many["doc_id"] % 100, full=many["sequence_id"].map(sizes) == 4096).query("full")
    shares = own.groupby(["sequence_id", "topic"])["length"].sum().groupby("sequence_id").max() / 4096
    assert shares.mean() > 0.4  # a twelfth by chance

import glob
import itertools
import math
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidewheel.llm import common, components, decontam, html_paths, ids, langid, line_rules, maxent, nbsvm, neardup, packing, paragraphs, pii

DOCS = "doc_id long, text string, lang string, source string, n_chars long, cid long, key string"
random.seed(3)
WORDS = ["".join(random.choice("abcdefgh") for _ in range(random.randint(2, 7))) for _ in range(800)]
prose = lambda n: " ".join(w + "." * (k % 9 == 8) for k, w in enumerate(random.choices(WORDS, k=n)))
BASE = prose(200)


def _table():
    near = BASE.split()
    near[100] = "changed"
    texts = [BASE, BASE, " ".join(near), prose(150), "", None, "one two", "x" * 30_000, prose(6000), "A " * 300, "### " * 30, BASE]
    return [(i, t, ["en", "fr"][i % 2], None, None if t is None else len(t), 1, "k") for i, t in enumerate(texts)]


TABLE = _table()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TABLE, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_every_operator_takes_odd_and_empty_tables(spark, docs, none):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(12)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, " ".join(BASE.split()[20:50])), (2, None), (3, "")], "item_id long, text string")
    for df, n in ((docs, 12), (none, 0)):
        assert packing.pack(df).select("doc_id").distinct().count() == n
        assert line_rules.measure(df).count() == n
        assert nbsvm.score(df, nbsvm.fit(df, labels, F.lit(True))).count() == n
        assert neardup.components_of(df).count() == n
        assert langid.identify(df, langid.fit(df, F.lit(True))).count() == n
        assert pii.detect(df).count() == n
        assert pii.redact(df).columns == df.columns
        assert maxent.language_scores(df).count() == n
        assert {r["doc_id"] for r in decontam.detect(df, bench).collect()} == ({0, 1, 2, 11} if n else set())
        assert {0, 1, 11} <= {r["doc_id"] for r in paragraphs.repeats(df).collect()} or not n


def slow_groups(rows, n, percent=80):
    """doc_id -> (set size, smallest id reachable), over all pairs."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {rows[k][0]: (len(sets[k]), rows[root(k)][0]) for k in range(len(rows))}


def similar_texts():
    rng, out = random.Random(9), []
    for _ in range(12):
        base = prose(rng.randint(20, 90)).split()
        for _ in range(rng.randint(1, 9)):
            text = altered(base, rng.randrange(4), rng)
            out.append(" ".join(text))
            base = text if rng.random() < 0.5 else base  # chains and stars
    out += ["one two three", "One two\nthree", "", "one"] + ["the same words " * 9] * 3
    return list(enumerate(out))


@pytest.mark.parametrize("limits", [{}, {"limit": 2, "division": 3, "member_limit": 100}, {"limit": 2, "member_limit": 100}])
def test_near_duplicates_against_brute_force(spark, limits):
    rows = similar_texts()
    got = neardup.components_of(spark.createDataFrame(rows, "doc_id long, text string"), **limits).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == slow_groups(rows, 4)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_one_document_of_each_group_stays(docs, spark):
    assert sorted(r["doc_id"] for r in neardup.keep_first(docs).collect()) == [0, 3, 4, 5, 6, 7, 8, 9, 10]
    a, b = "a b c d e f g h", "q w e r t y u i"
    odd = [(None, a), (None, a), (1, b), (1, prose(30)), (1, b), (2, b), (3, None), (3, ""), (None, None)]
    kept = neardup.keep_first(spark.createDataFrame(odd, "doc_id long, text string")).collect()
    assert Counter(map(tuple, kept)) == Counter([(None, a), (1, b), odd[3], (3, None), (3, ""), (None, None)])


@pytest.mark.parametrize("held", [components.HELD_EDGES, 4])
def test_components(spark, held):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(1, 9)] + [(20, 21), (21, 22), (30, 22)] + [(100 + rng.randrange(80), 100 + rng.randrange(80)) for _ in range(60)] + [(500, k) for k in range(501, 560)]
    parent = {x: x for l in links for x in l}
    for _ in range(len(parent)):
        for a, b in links:
            parent[a] = parent[b] = min(parent[a], parent[b])
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long"), held).collect()}
    assert got == {k: v for k, v in parent.items() if any(a != b and k in (a, b) for a, b in links)}


def test_packing_keeps_every_id(docs):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(packing.default_vocabulary())
    rows = packing.pack(docs).collect()
    for i, text, *_ in TABLE:
        ids, own = [*model.encode(text or "", add_special_tokens=False).ids, 0], sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
        assert sum(r["length"] for r in own) == len(ids) == own[0]["doc_tokens"]
        assert all(zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"] for r in own)
    by: dict = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == by.get(r["sequence_id"], 0)
        by[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(by.values()) <= packing.WINDOW


def test_byte_tokenizer_equals_the_library():
    coder = packing.ByteTokenizer(packing.default_vocabulary())
    some = list("aA1'.,;-\n\t\r    é日ß\u0301\u200d😀🏽힣٣²½_ﬁİ'sll're") + ["<|endoftext|>"]
    texts = ["", "a  b", " lead", "tail ", "x\n y", "\0 a", "x" * 5_000, " \n" * 5_000, "ab" + " " * 5_000 + "c"]
    texts += ["".join(random.choices(some, k=25)) for _ in range(2_000)]
    texts += [f"a{chr(c)}b {chr(c)}1 {chr(c)}{chr(c)}." for c in range(0x3400) if not 0xD800 <= c < 0xE000]
    assert coder.fast is not None
    for text, ids in zip(texts, coder.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == coder.model.encode(text, add_special_tokens=False).ids


def test_plan_uses_each_length_exactly():
    want = {k: random.randint(0, 50) for k in range(1, 1024, 7)}
    made: dict = {}
    for combo, n in packing.plan(want):
        assert sum(combo) <= 1024
        for k in combo:
            made[k] = made.get(k, 0) + n
    assert made == {k: v for k, v in want.items() if v}


def test_base_spans_equal_plain_patterns():
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    for _ in range(3000):
        text = "".join(random.choices("a1.@-+ _", k=30))
        assert pii.emails(text) == [m.span() for m in email.finditer(text)]
    base, spans = pii.find("call +1 (017) 555-7713 or 4417744280351548 at 10.0.0.255, IBAN GB82WEST12345698765432")
    assert [s[0] for s in base][:1] == ["ip"] and "phone" in {s[0] for s in base} and "iban" in {s[0] for s in spans}
    assert pii.luhn("4539578763621486") and pii.mod97("GB82WEST12345698765432")


def test_html():
    page = "<html><head><title>t</title><style>p{}</style></head><body><nav><a>menu</a></nav><div class=ad>buy</div><article><h1>Head &amp; all</h1><p><b>One\n two<br><p>Three.</article><footer>f</footer>"
    assert html_paths.main_text(page) == "Head & all\nOne two\nThree."
    assert html_paths.main_text(None) == html_paths.main_text("") == ""
    assert "long text" in html_paths.main_text("<div><a>x</a></div><div><p>" + "A long text, with marks. " * 20 + "</p></div>")


def test_segmentations_against_brute_force():
    pieces = ["▁", "a", "b", "ab", "ba", "▁ab", "abababababab"]
    model = langid.Model(pieces, ["x", "y"], [("ab ab a " + "ab" * 40, "x"), ("ba ba b", "y")])

    def slow(word):
        known, total = dict(zip(pieces, model.prob, strict=False)), np.zeros(2)
        for cuts in itertools.product([0, 1], repeat=len(word) - 1):
            edges = [0, *(i for i, c in enumerate(cuts, 1) if c), len(word)]
            value = np.ones(2)
            for i, j in itertools.pairwise(edges):
                value = value * known.get(word[i:j], langid.UNKNOWN if j - i == 1 else 0.0)
            total += value
        return np.log10(total)

    for word in ("▁abab", "▁aabbaz", "▁ba", "▁" + "ab" * 6):
        assert np.allclose(model.log_words([word])[0], slow(word)) and np.allclose(model.log_long(word), slow(word))


def test_languages(spark):
    some = {"l1": "abcde", "l2": "cdefg"}
    rng = random.Random(4)
    word = lambda lang: "".join(rng.choice(some[lang]) for _ in range(4))
    rows = [(k, " ".join(word(lang) for _ in range(30)), lang) for k in range(200) for lang in [["l1", "l2"][k % 9 == 0]]]
    rows += [(900, "½ ² 12", "l1"), (901, None, "l2"), (902, "", None), (None, rows[0][1], "l1"), (0, rows[0][1], "l1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df, langid.fold("doc_id", 4) != 2, sample_docs=40)
    got = langid.identify(df, model).collect()
    assert len(langid.vocabulary(langid.default_vocabulary())) > 31_000 and len(got) == len(rows)
    right = [r["lang_pred"] == rows[r["doc_id"]][2] for r in got if r["doc_id"] is not None and r["doc_id"] < 200 and r["held_out"]]
    assert np.mean(right) > 0.95  # the rarer language has half of the sample
    assert {r["doc_id"]: r["lang_pred"] for r in got if r["doc_id"] in (900, 901, 902)} == dict.fromkeys((900, 901, 902), "und")
    assert [r["held_out"] for r in got if r["doc_id"] is None] == [None] and {r["lang_pred"] for r in langid.identify(df, langid.fit(df, F.lit(False))).collect()} == {"und"}


def test_language_model_against_brute_force(spark, docs):
    rows = [(r[0], r[1]) for r in TABLE] + [(None, "alone here"), (3, "alone too")]
    got = maxent.language_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    cut = lambda t: [*(t or "").lower().encode().split(), b"\n"]
    c = Counter(w for d, t in rows if d is not None and zlib.crc32(str(d).encode()) % 7 != 2 for w in cut(t))
    total, distinct = sum(c.values()), len(c)
    want = Counter()
    for d, t in rows:
        base = sum(math.log10((c[w] + 1) / (total + distinct + 1)) for w in cut(t))
        want[d, len(cut(t)), sum(w in c for w in cut(t)), total, round(base, 5)] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got) == want
    assert all(r["held_out"] == (None if r["doc_id"] is None else zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2) for r in got)


def test_language_model_is_proper_and_learns(spark):
    """Probabilities of all tokens and of an unseen one sum to 1 after any history; bigrams of held-out text gain."""
    rng = random.Random(8)
    after = {w: rng.sample(WORDS, 3) for w in WORDS}
    texts = []
    for k in range(400):
        w = rng.choice(WORDS)
        texts.append((k, " ".join(w := rng.choice(after[w]) for _ in range(120))))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    held = langid.fold("doc_id", 7) == 2
    coded = maxent.stash(maxent.code(df, ~held, held))
    counts = maxent.stash(maxent.count(coded))
    model = maxent.fit(coded, counts)
    c = {r["h"]: r["c"] for r in counts.collect()}
    coder = maxent.Coder()
    for history in ("", WORDS[0], f"{WORDS[5]} {WORDS[1]}"):
        ends = [*sorted(after), "never-seen"]  # a word that no text holds stands for all such ones of its form and place
        lens, numbers = coder([f"{history} {w}".encode() for w in ends])
        own = maxent.Chunk(coder.chunk(list(range(len(ends))), [False] * len(ends), [False] * len(ends), [lens], [numbers]))
        rare, _, logs = model.of(own)
        at = np.cumsum(lens) - 2  # the word itself
        often = np.array([c.get(int(h), 0) for h in own.hashes[own.stream[at]]])
        words = 10 ** (logs[at] + np.where(rare[at], np.log10(often + 1), 0))
        tokens = own.coded(model.known)
        group = tokens[4][at]
        assert words.sum() < 1 and np.isfinite(words).all() and (group < maxent.CLASSES).all()
    z = np.random.default_rng(1).normal(size=(5, maxent.CLASSES)).astype(np.float32)
    assert np.allclose(np.exp(model.weights.log_soft(z)[0]).sum(1), 1, atol=1e-5)
    mass = counts.groupBy("leaf").agg(F.sum(F.col("c") + 1).alias("m")).collect()
    known = {int(h) for h in model.known}
    leaf = Counter()
    for r in counts.collect():
        if r["h"] not in known:
            leaf[r["leaf"]] += r["c"] + 1
    assert len(mass) and all(math.isclose(10 ** model.rare_log[k // maxent.PLACES, k % maxent.PLACES], v + 1) for k, v in leaf.items())
    rows = [r for r in maxent.language_scores(df).collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_quality_on_held_out_rows(spark):
    rng = random.Random(6)
    rows = [(k, prose(60) if k % 3 else " ".join([rng.choice(["buy", "now", "$$$", "free!!"])] * 5 + prose(10).split())) for k in range(300)]
    rows += [(None, prose(9)), (500, None), (501, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("doc_id2", F.lit(1))
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(300)] + [(7, None, 0)], "doc_id long, quality int, toxic int")
    model = nbsvm.fit(df, labels, langid.fold("doc_id", 5) != 0)
    got = nbsvm.score(df, model).collect()
    right = [r["predicted"] == int(r["doc_id"] % 3 > 0) for r in got if r["doc_id"] is not None and r["doc_id"] < 300 and r["held_out"]]
    assert np.mean(right) > 0.95 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got) and len(got) == len(rows)
    kept = nbsvm.keep_good(df, model)
    assert kept.columns == df.columns and kept.count() == sum(r["predicted"] for r in got)


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def slow_base(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = [int(x) for x in m[0] if x in "0123456789"]
            odd = [d * 2 - 9 * (d > 4) if i % 2 else d for i, d in enumerate(reversed(digits))]
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 16 <= len(digits) <= 19 and sum(odd) % 10 == 0, "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, *m.span()))
    return out


def test_base_spans_against_plain_patterns():
    rng = random.Random(12)
    parts = ["a@b.co", "x.y+z@m-n.o.p", "10.0.0.255", "1.2.3.4.5.6.7.8", "4539578763621486", "4539 5787-6362 1486", "+1 (017) 555-7713", "+49", "٣", "é", "256.1.1.1", "@", ".", "-", " ", "12", "4"]
    for _ in range(6000):
        text = "".join(rng.choices(parts, k=rng.randint(1, 9)))
        assert pii.base_spans(text) == slow_base(text), text


def test_further_spans_and_long_texts():
    free = pii.outside([(5, 9), (2, 20), (30, 31)])
    for a in range(40):
        for b in range(a + 1, 41):
            assert free(a, b) == (not any(x < b and a < y for x, y in [(5, 9), (2, 20), (30, 31)]))
    kinds = lambda t: [k for k, _, _ in pii.find(t)[1]]
    assert kinds("ssn 123-45-6789") == ["ssn"] and kinds("part 123-45-6789") == [] and kinds('token = "abcdefgh12"') == ["secret"]
    assert kinds("GB82WEST12345698765432") == ["iban"] and kinds("IBAN GB83WEST12345698765432") == []
    alone, near = (pii.scored_spans(t, [])[0][3] for t in ("GB82WEST12345698765432", "IBAN GB82WEST12345698765432"))
    assert near > alone
    start = time.perf_counter()
    pii.find("a@b.co 123-45-6789 " * 20_000)
    pii.find("1" * 200_000 + "." * 200_000 + "a" * 200_000)
    assert time.perf_counter() - start < 10


def altered(words, edits, rng):
    words = list(words)
    for _ in range(edits):
        at, kind = rng.randrange(len(words)), rng.randrange(3)
        words[at : at + (kind != 0)] = [f"zz{rng.randrange(10**6)}"] if kind < 2 else []
    return words


def test_recall_at_the_threshold():
    rng = random.Random(17)
    items = [(k, prose(rng.randint(15, 60))) for k in range(60)]
    finder, hit, n = decontam.Finder(items), 0, 0
    for k, text in items * 3:
        ws = decontam.words_of(text)
        found = finder.find([" ".join(["pre"] * 40 + altered(ws, finder.slack(len(ws)), rng) + ["post"] * 40)])
        hit, n = hit + any(r[1] == k for r in found), n + 1
    assert hit / n >= 0.95
    assert len(finder.find([t for _, t in items])) >= 60  # all exact ones


def slow_infix(item, region):
    row = [(0, j) for j in range(len(region) + 1)]
    for i, x in enumerate(item, 1):
        new = [(i, row[0][1])]
        for j, y in enumerate(region, 1):
            new.append(min((row[j - 1][0] + (x != y), row[j - 1][1]), (row[j][0] + 1, row[j][1]), (new[j - 1][0] + 1, new[j - 1][1])))
        row = new
    end = min(range(len(row)), key=lambda j: (row[j][0], j))
    return row[end][0], row[end][1], end


def test_edit_distance_against_dynamic_programming():
    rng = random.Random(5)
    for _ in range(1500):
        item, region = [rng.randrange(4) for _ in range(rng.randint(1, 9))], [rng.randrange(4) for _ in range(rng.randint(0, 14))]
        assert decontam.infix_distance(item, region) == slow_infix(item, region)


def test_leaks_against_brute_force(spark):
    rng, items = random.Random(3), [(k // 2, prose(30)) for k in range(6)]  # two texts per id
    docs = [(1, prose(200) + " " + items[0][1]), (2, items[3][1]), (2, prose(100)), (None, "x " + items[4][1] + " y"), (4, None), (5, ""), (6, prose(300))]
    docs += [(10 + k, prose(60) + " " + " ".join(altered(items[k][1].split(), 3, rng)) + " " + prose(60)) for k in range(6)]
    table, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items + [(None, prose(9)), (9, None)], "item_id long, text string")
    want = set()
    for doc, text in docs:
        words = decontam.words_of(text)
        for item, t in items:
            ws = decontam.words_of(t)
            if slow_infix(ws, words)[0] <= int(0.2 * len(ws) + 1e-9):
                want.add((doc, item))
    got = decontam.detect(table, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and all(math.isclose(r["similarity"], 1 - r["edits"] / 30) for r in got)
    assert decontam.detect(table, bench, part_chars=100).count() == len(got)
    leaky = {d for d, _ in want}
    assert sorted(r["text"] or "" for r in decontam.drop_leaky(table, bench).collect()) == sorted(t or "" for d, t in docs if d not in leaky or (d == 2 and t == docs[2][1]))


def test_line_rules(spark):
    rows = [(1, "A good sentence stands here, with words enough for all. " * 2), (2, "home | news | about | more | mail | help | jobs | shop | go | in | it | now."), (3, "the same words again and " * 20)]
    got = {r["doc_id"]: r for r in line_rules.measure(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[3]["base_failed"] and not got[2]["kept"] and not got[2]["base_failed"]
    assert got[3]["n_repeat_words"] == 100


def test_passages_are_found_at_any_offset_and_wrap(spark):
    """50 words amid long lines, or wrapped into lines of five words, in two documents each."""
    rows, fresh = [], random.Random(11)
    some = lambda n: [f"w{fresh.randrange(10**6)}" for _ in range(n)]
    for k in range(150):
        passage = some(50)
        for side in range(2):
            before, after = some(fresh.randrange(90)), some(fresh.randrange(90))
            lines = [before + passage + after] if k % 2 else [before, *[passage[i : i + 5] for i in range(0, 50, 5)], after]
            rows.append((2 * k + side, "\n".join(map(" ".join, lines))))
    rows.append((999, " ".join(some(400))))
    rows.append((1000, "a " * 400))
    found = paragraphs.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in found} - {1000} == set(range(300))
    inside = sorted(r["start_word"] for r in found if r["doc_id"] == 1000)  # repeats itself, without overlaps
    assert all(b - a >= paragraphs.SPAN for a, b in zip(inside, inside[1:], strict=False))


def test_short_lines_take_part_as_paragraphs(spark):
    """Nine lines of six words, one word changed between two documents."""
    words = [f"v{i}" for i in range(54)]
    other = [*words[:27], "changed", *words[28:]]
    wrap = lambda ws: "\n".join(" ".join(ws[i : i + 6]) for i in range(0, 54, 6))
    found = paragraphs.repeats(spark.createDataFrame([(1, wrap(words)), (2, wrap(other))], "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["n_words"]) for r in found} >= {(1, 54), (2, 54)}


def test_pipeline_compares_five_words(spark):
    """Two changed words among 80: 69 / 85 of the four-word shingles are common, 66 / 86 of the five-word ones."""
    import corpus_pipeline

    words = [f"u{i}" for i in range(80)]
    other = [*words[:30], "x", *words[31:50], "y", *words[51:]]
    both = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other))], "doc_id long, text string")
    assert corpus_pipeline.near_dedup(spark, both, "").count() == 2
    assert neardup.keep_first(both).count() == 1


def test_html_without_names_and_article():
    body = "".join(f"<p>Sentence {k} of the text, long enough to count, stands here. " + "More words follow it, and more. " * 6 + "</p>" for k in range(5))
    around = "<div>" + "".join(f"<a href=/{k}>Item {k}</a> " for k in range(12)) + "</div>"
    text = html_paths.main_text(f"<html><body>{around}<div><div>{body}</div></div>{around}</body></html>")
    assert text.count("Sentence") == 5 and "Item" not in text
    named = html_paths.main_text(f"<div>{body}</div><div class='ad-box'><p>{'Buy this, it is good. ' * 20}</p></div><div class='share-price'><p>{'The price fell, then it rose. ' * 60}</p></div>")
    assert "Buy" not in named and "price fell" in named


def test_html_ratios_decide(monkeypatch):
    body = "<div><p>" + "A long text, with marks. " * 30 + "</p></div><ul>" + "<li><a>tag</a></li>" * 30 + "</ul>"
    assert "tag" not in html_paths.main_text(body)
    monkeypatch.setattr(html_paths, "SIGMAS", 0)  # without a threshold on the ratios
    assert "tag" in html_paths.main_text(body)


def test_html_odd_pages(spark):
    assert html_paths.main_text("<p>A&am<b>p;</b> stays") == "A&amp; stays" and html_paths.main_text("<p>A &amp; b&#8364;") == "A & b€"
    assert html_paths.main_text('<p><a title="x>text</a> more') == "text more"
    start = time.perf_counter()
    for page in ("<b>" * 100_000 + "x", "<div>" * 100_000 + "x", "<!" * 100_000, '<a "' * 50_000, "<p><i>" * 50_000 + "x"):
        html_paths.main_text(page)
    assert time.perf_counter() - start < 30
    rows = [(1, "u", "<p>One, two."), (1, "u", "<p>One, two."), (2, None, None), (None, "v", ""), (3, "w", "plain words")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = html_paths.extract(df).collect()
    assert [(r["page_id"], r["text"], r["n_chars"]) for r in got] == [(1, "One, two.", 9)] * 2 + [(2, "", 0), (None, "", 0), (3, "plain words", 11)]
    assert html_paths.extract(df.limit(0)).count() == 0


def test_html_threshold_decides_on_every_page():
    body = "".join(f"<p>Sentence {k} of the body, which is <b>long enough</b> <i>to count</i>, stands here. " + "More words follow, and more. " * 8 + "</p>" for k in range(6))
    junk = "<div class=tags>" + "".join(f"<a href=/{k}>tag{k}</a> " for k in range(30)) + "</div>"
    within = html_paths.main_text(f"<article><h1>A heading of some words</h1>{body}{junk}</article>")
    without = html_paths.main_text(f"<div><h1>A heading of some words</h1>{body}</div>{junk}")
    beside = html_paths.main_text(f"<article><h3>Teaser</h3><p>Read on.</p></article><div id=body>{body}</div>")
    for text in (within, without, beside):
        assert "tag3" not in text and "long enough to count" in text and "Sentence 5" in text
    assert within == without and within.startswith("A heading")


def test_passages_against_brute_force(spark):
    """Who shares 50 words on end with another document, or with itself elsewhere; short common lines don't count."""
    rng = random.Random(21)
    some = lambda n: [f"w{rng.randrange(10**5)}" for _ in range(n)]
    shared, line = [some(rng.randint(51, 90)) for _ in range(8)], some(12)
    rows = []
    for k in range(60):
        parts = [some(rng.randint(5, 120)), line, shared[k % 8] if k % 3 == 0 else [], some(rng.randint(5, 120))]
        rows.append((k, "\n".join(" ".join(p) for p in parts)))
    rows += [(100, rows[1][1]), (None, rows[2][1]), (101, None), (102, ""), (1, rows[1][1])]
    grams = {}
    for k, (_, text) in enumerate(rows):
        w = (text or "").split()
        for i in range(len(w) - 49):
            grams.setdefault(tuple(w[i : i + 50]), set()).add(k)
    want = {rows[k][0] for v in grams.values() if len(v) > 1 for k in v}
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("cid", F.lit("clash"))
    got = paragraphs.repeats(df, member_limit=200).collect()
    assert {r["doc_id"] for r in got} == want and all(r["passage_words"] >= paragraphs.SPAN for r in got)
    by = {}
    for r in got:
        by.setdefault(r["cluster_id"], []).append(r)
    assert all(sum(not r["removed"] for r in v) >= 1 and v[0]["copies"] == len(v) for v in by.values())


def test_linked_sets_against_all_pairs():
    rng = random.Random(1)
    rows = []
    for k in range(60):
        base = rng.sample(range(40), 20)
        rows.append((k, k, np.array(sorted(base[: rng.randint(10, 20)]), np.uint64)))
        rows.append((100 + k, 100 + k, np.array(sorted(base), np.uint64)))
    edges = [(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if 100 * len(np.intersect1d(a[2], b[2])) >= 80 * len(np.union1d(a[2], b[2]))]
    u, v = (np.array(x, np.int64) for x in zip(*edges, strict=True))
    got = np.array(paragraphs.linked_sets(rows, 80), np.int64)
    assert set(map(tuple, got)) <= set(edges)
    assert all((a == b).all() for a, b in zip(components.least_of(u, v), components.least_of(*got.T), strict=True))


def test_filters_on_odd_tables(spark, docs, none):
    bench = spark.createDataFrame([(1, " ".join(BASE.split()[20:50]))], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = nbsvm.fit(docs, labels, F.lit(True))
    for df in (docs, none):
        for out in (decontam.drop_leaky(df, bench), nbsvm.keep_good(df, model), line_rules.clean(df), neardup.keep_first(df)):
            assert out.columns == df.columns and out.count() <= df.count()


def test_pipeline_against_its_parts(spark, tmp_path):
    """The rows of run(): each stage's decision on plain Python, then ids by the library."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    rng = random.Random(30)
    rows = [(k, t, "en", "s", len(t)) for k, t in similar_texts()]
    rows += [(200 + k, prose(40) + f" mail a{k}@b.co", "en", None, 9) for k in range(10)] + [(300 + k, "buy now $$$ free!! " * 6 + prose(5), None, "s", 1) for k in range(20)]
    items = [(k, prose(30)) for k in range(3)]
    rows += [(400 + k, prose(50) + " " + " ".join(altered(items[k][1].split(), 4, rng)), "en", "s", 2) for k in range(3)] + [(500, None, None, None, None)]
    marks = [(k, int(not 300 <= k < 320), 0) for k, *_ in rows]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    table = corpus_pipeline.table(spark, str(tmp_path), "documents")
    model = nbsvm.fit(table, corpus_pipeline.table(spark, str(tmp_path), "labels"), corpus_pipeline.fold("doc_id", 5) != 0)
    scratch = np.zeros(1 << nbsvm.BITS, bool)
    left = [(r[0], r[1]) for r in rows if model.score(r[1], scratch) >= nbsvm.CUT]
    assert not any(300 <= k < 320 for k, _ in left)
    groups = slow_groups(left, 5)
    left = [(k, t) for k, t in left if groups[k][1] == k]
    left = [(k, t) for k, t in left if not any(slow_infix(decontam.words_of(i), decontam.words_of(t))[0] <= 6 for _, i in items)]
    tokenizer = Tokenizer.from_file(packing.default_vocabulary())
    want = {k: [*tokenizer.encode(pii.mask(t or "", pii.find(t)[1]), add_special_tokens=False).ids, 0] for k, t in left}
    assert {r["doc_id"]: r["doc_tokens"] for r in got} == {k: len(v) for k, v in want.items()}
    assert all(zlib.crc32(np.array(want[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"] for r in got)


def shuffled(spark):
    """Bytes that this session's tasks have given to shuffles."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    return sc.statusStore().executorSummary("driver").totalShuffleWrite()


def test_near_duplicates_leave_texts_where_they_are(spark):
    """Texts are not shuffled to look up sets or to keep rows, also where ids are too many for a broadcast join."""
    rng = random.Random(12)
    rows = [(k, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=40_000)) + f" {k}") for k in range(60)]
    rows += [(100 + k, f"{BASE} and {k % 2}") for k in range(4)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        df = spark.createDataFrame(rows, "doc_id long, text string")
        before = shuffled(spark)
        assert {r["doc_id"] for r in neardup.components_of(df).where("not kept").collect()} == {101, 102, 103}
        assert {r["doc_id"] for r in neardup.keep_first(df).collect()} == {*range(60), 100}
        assert shuffled(spark) - before < 400_000  # of 2.4 MB, twice
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("held", [0, 5, ids.HELD])
def test_ids_are_told_apart_exactly(spark, held):
    df = spark.range(-500, 4_500).withColumn("in", F.col("id") % 7 == 3)
    inside, outside = df.where("in").select("id"), df.where("not in").select("id")
    there = ids.among(inside, outside, held)(F.col("id"))
    assert {r["id"] for r in df.where(there).collect()} == {r["id"] for r in inside.collect()}
    loose = ids.maybe(spark, ids.bits_of(inside), F.col("id"))
    assert df.where("in").where(loose).count() == inside.count() and df.where("not in").where(loose).count() < 600


def test_language_model_holds_a_slice_of_features():
    """Features of a chunk are made some tokens at a time, with the same results as all at once."""
    texts = [" ".join(random.Random(k).choices(WORDS, k=[0, 1, 2, 3000][k % 4])).encode() for k in range(2_000)]
    coder = maxent.Coder()
    lens, numbers = coder(texts)
    own = maxent.Chunk(coder.chunk(list(range(len(texts))), [True] * len(texts), [False] * len(texts), [lens], [numbers]))
    known = own.hashes[: maxent.KNOWN]
    parts = list(own.slices(known, 4_099))
    assert all((np.concatenate(x) == y).all() for x, y in zip(zip(*parts, strict=True), own.coded(known), strict=True))
    model = maxent.Model(known, np.ones(maxent.KNOWN), maxent.Weights.start(np.ones((maxent.CLASSES, maxent.PLACES))), np.ones((maxent.FORMS, maxent.PLACES)), 10**6, 10**5)
    tracemalloc.start()
    try:
        model.of(own)
        assert tracemalloc.get_traced_memory()[1] < 55 * len(own.stream)  # bytes; all features at once take 80 a token
    finally:
        tracemalloc.stop()


def test_language_model_sums_by_document_in_little_memory():
    texts = [" ".join(random.Random(k).choices(WORDS, k=[0, 1, 2, 3000][k % 4])).encode() for k in range(2_000)]
    coder = maxent.Coder()
    lens, numbers = coder(texts)
    own = maxent.Chunk(coder.chunk(list(range(len(texts))), [True] * len(texts), [False] * len(texts), [lens], [numbers]))
    model = maxent.Model(own.hashes[:300], np.ones(300), maxent.Weights.start(np.ones((maxent.CLASSES, maxent.PLACES))), np.ones((maxent.FORMS, maxent.PLACES)), 10**6, 10**5)
    rare, base, logs = model.of(own)
    at = np.repeat(np.arange(len(lens)), lens)
    tracemalloc.start()
    try:
        told, doc, sums = model.sums(own)
        t, holders = maxent.lines_up(own.stream[told], doc[told])
        assert tracemalloc.get_traced_memory()[1] < 42 * len(own.stream)  # bytes, a third of them for features; arrays for all tokens took 63
    finally:
        tracemalloc.stop()
    assert (told == rare).all() and (doc == at).all() and all(np.allclose(x, np.bincount(at, y, len(lens))) for x, y in zip(sums, (~rare, base, logs), strict=True))
    want = sorted(zip(own.stream[rare].tolist(), at[rare].tolist(), strict=True))
    assert [(k, d) for k, x in zip(t.tolist(), holders.to_pylist(), strict=True) for d in np.frombuffer(x, "<u2").tolist()] == want


def test_chunks_of_the_language_model_are_read_one_at_a_time(spark, monkeypatch):
    """Each chunk is a row group and a page; what is left at the end is the result alone."""
    tables, groups = [], []

    def kept(df, *values, **options):
        out = common.stash(df, *values, **options)
        tables.append(out)
        if "blob" in out.columns:
            groups.extend(pq.ParquetFile(f).metadata for f in glob.glob(f"{out._stash_path}/*.parquet"))
        return out

    monkeypatch.setattr(maxent, "stash", kept)
    df = spark.createDataFrame([(k, "some words of ") for k in range(4)], "doc_id long, text string").withColumn("text", F.expr("repeat(text, 500000)"))
    got = {r["doc_id"]: r["n_tokens"] for r in maxent.language_scores(df.coalesce(1)).collect()}
    assert got == {k: 1_500_001 for k in range(4)}
    assert [m.row_group(k).num_rows for m in groups for k in range(m.num_row_groups)] == [1] * 4
    assert [bool(glob.glob(f"{t._stash_path}/*")) for t in tables] == [False] * (len(tables) - 1) + [True]


def test_batches_for_a_stashed_table_are_bounded_in_bytes(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    df = spark.range(0, 9_000, 1, 1).select(F.repeat(F.lit("x"), 2_000).alias("text"))
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    out = [r["n"] for r in common.stash(df.mapInArrow(sizes, "n long")).collect()]
    assert sum(out) > 18e6 and max(out) < 6e6 and spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_files_of_a_written_tables_shuffles_go_at_once(spark):
    def files():
        found = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
        return sum(found.apply(k).getName().startswith("shuffle_") for k in range(found.size()))

    before = files()
    out = common.stash(spark.range(10_000).repartition(3).groupBy((F.col("id") % 99).alias("k")).count())
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before and out.count() == 99 and spark.conf.get(common.CLEAN_UP, None) in (None, "false")


def test_freed_memory_goes_back():
    anonymous = lambda: next(int(x.split()[1]) for x in open("/proc/self/status") if x.startswith("RssAnon")) / 1024
    common.give_back()
    before = anonymous()
    words = [b"%020d" % k for k in range(1_500_000)]
    words = words[::100_000]  # the last of these keep a heap from shrinking by itself
    common.give_back()
    assert len(words) == 15 and anonymous() - before < 40


def test_pipeline_stages_hold_few_rows_and_give_memory_back(spark, monkeypatch, docs):
    import corpus_pipeline

    key, back = "spark.sql.execution.arrow.maxBytesPerBatch", []
    before = spark.conf.get(key)
    texts = [BASE, "mail me@example.org", None, prose(40)] * 1_000
    batch = pa.RecordBatch.from_arrays([pa.array(range(4_000)), pa.array(texts)], names=["doc_id", "text"])
    plain = docs.select("doc_id", "text")
    items = spark.createDataFrame([(1, prose(20))], "item_id long, text string")
    monkeypatch.setattr(type(plain), "mapInArrow", lambda self, f, schema: f)
    monkeypatch.setattr(common, "give_back", lambda: back.append(1))
    model = nbsvm.Model([BASE, prose(60)], [1, 1])
    for run in (nbsvm.keep_good(plain, model), decontam.drop_leaky(plain, items), pii.redact(plain)):
        out, told = list(run(iter([batch]))), len(back)
        assert told == 1 and sum(b.num_rows for b in out) == 4_000 and max(b.num_rows for b in out) <= 1_024
        back.clear()
    monkeypatch.undo()
    try:
        corpus_pipeline.STAGES[3][1](spark, docs, "")
        assert spark.conf.get(key) in ("4MB", f"{4 << 20}b")
    finally:
        spark.conf.set(key, before)


def test_near_duplicates_with_a_filter_that_lets_many_through(spark, monkeypatch):
    """Sets that no pair asked for change nothing, nor do null and repeated ids; too many ids to leave out are joined."""
    monkeypatch.setattr(ids, "MOST_BITS", 1)
    rows = similar_texts()
    df = spark.createDataFrame([*rows, (None, rows[0][1]), (3, "another text of some other words here")], "doc_id long, text string")
    want = slow_groups(rows, 4)
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in neardup.components_of(df).collect()}
    assert {k: (n, got[k, n]) for k, (n, _) in want.items()} == want and got[None, want[0][0]] == want[0][1]
    kept = Counter(r["doc_id"] for r in neardup.keep_first(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4).collect())
    assert kept == Counter(k for k, (_, first) in want.items() if k == first)

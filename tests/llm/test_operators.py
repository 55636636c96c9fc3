"""Each operator against a plain version, on rows that are out of the ordinary."""

import collections
import hashlib
import io
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orelode.llm import cluster, decontaminate, fertility, gated_lm, jaccard_join, language_id, repair_codec, sentence_fst, textbuf, token_counts, warc, window_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RNG = random.Random(11)
VOCABULARY = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randrange(2, 9))) for _ in range(900)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def low(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


PASSAGE = prose(60)
BASE = prose(400)
ITEMS = [(0, prose(25)), (1, prose(40)), (2, "tiny item of five words"), (3, "Solo"), (None, prose(12)), (5, None), (6, "..."), (1, prose(14))]


def near(text, edits):
    words = text.split()
    for i in range(edits):
        words[17 * i + 5] = f"edit{RNG.randrange(10**9)}"
    return " ".join(words)


TEXTS = [
    None, "", "   \n\t ", "one", "one", "two words", "Two  WORDS", "a b c", BASE, BASE, near(BASE, 1), near(BASE, 3), near(BASE, 5), near(BASE, 8),
    prose(30) + " " + PASSAGE + " " + prose(30), prose(10) + "\n" + PASSAGE.replace(" ", "\n") + ". " + prose(10), "x " * 500, "ab ba " * 60,
    prose(5) + " " + ITEMS[0][1] + " " + prose(5), prose(3) + ". " + " ".join(ITEMS[1][1].upper().split()[5:19]) + ". end", "here a tiny-item of FIVE words, and solo", ITEMS[4][1],
    "<|endoftext|> hi<|endoftext|>there <|startoftext|>", "▁mark ▁ and  spaces ", "nul\0inside \0", "漢字 кириллица ελληνικά ñandú é", "emoji 🙂🙂 ​ zero", "line\nline\n\nline\n x \nline", "## ** $$ %% && || <> " * 30,
    prose(30000), "a" * 20000, " " * 9000 + "b", ("word, " * 3000) + "end.",
]
LANGS = ["en", "fr", None, "de"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, LANGS[i % 4], None if i % 5 == 0 else "src", len(t or ""), "clash", b"x", i) for i, t in enumerate(TEXTS)]
    rows += [(None, near(BASE, 2), None, None, None, None, None, None), (None, "null id", "en", "s", 1, "c", b"", 0), (8, BASE, "en", "s", 1, "c", b"", 0), (3, "another three", "en", "s", 1, "c", b"", 0)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, _body string, _md5 binary, bucket int"
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def table(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def empty(docs):
    return docs.where("false")


def test_textbuf_against_regex():
    texts = [t or "" for t in TEXTS]
    for fold, pattern in ((textbuf.PLAIN, WORD), (textbuf.ALNUM_FOLDED, re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"))):
        w = textbuf.words(pa.array(texts).cast(pa.binary()), fold)
        data = w.raw.tobytes()
        for d, t in enumerate(texts):
            own = [data[a:b].decode() for a, b in zip(w.starts[w.first[d] : w.first[d + 1]], w.ends[w.first[d] : w.first[d + 1]], strict=True)]
            assert [low(x) for x in own] == [low(x) for x in pattern.findall(low(t))]
    h = textbuf.words(pa.array(["a b c a b c d"]).cast(pa.binary())).hashes()
    w = textbuf.windows(h, 3)
    assert w[0] == w[3] and len(set(w.tolist())) == 4


# 2


def brute_components(rows, k, num, den):
    sets = []
    for _, t in rows:
        w = WORD.findall(low(t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None and sets[i]:
            r = find(i)
            least[r] = min(key, least.get(r, key))
    return sorted(((key, len(sets[i]), least.get(find(i), key) if sets[i] else key) for i, (key, _) in enumerate(rows)), key=str)


def test_jaccard_components(docs, rows):
    assert table(jaccard_join.component_digest(docs)) == brute_components(rows, 3, 90, 100)
    assert table(jaccard_join.component_digest(docs, 5, 80, 100)) == brute_components(rows, 5, 80, 100)
    assert table(jaccard_join.component_digest(empty(docs))) == []


@pytest.mark.parametrize("bits", [jaccard_join.LIST_BITS, 2])
def test_jaccard_large_classes(spark, monkeypatch, bits):
    """More copies than a short list holds: stars whose ends don't link, chains, and unlike texts with a shared passage; lists
    whole and in parts."""
    monkeypatch.setattr(jaccard_join, "LIST_BITS", bits)
    rng = random.Random(3)
    base = prose(220, rng)
    rows = [(i, near(base, 1 + i % 6)) for i in range(60)] + [(100, base)]
    rows += [(200 + i, prose(40, rng) + " " + PASSAGE) for i in range(40)]
    chain = prose(150, rng).split()
    rows += [(300 + i, " ".join(chain[4 * i : 4 * i + 100])) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    for k, num in ((3, 90), (5, 80)):
        assert table(jaccard_join.component_digest(df, k, num, 100)) == brute_components(rows, k, num, 100)


def test_jaccard_lists_of_several_components(spark, monkeypatch):
    """With an order that knows nothing, long lists hold many components, and the second round has to find links."""
    monkeypatch.setattr(jaccard_join, "SHORT", 2)
    monkeypatch.setattr(jaccard_join, "PART", 7)  # so that lists have several parts
    rng = random.Random(8)
    shared = prose(90, rng)
    rows = [(i, " ".join([*shared.split()[:80], *prose(6, random.Random(i // 3)).split(), *(prose(1, random.Random(i)).split())])) for i in range(45)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert table(jaccard_join.component_digest(df)) == brute_components(rows, 3, 90, 100)


def test_jaccard_pairs_across(spark, monkeypatch):
    """Of a list all pairs of different roots that sizes and positions allow, once or more, and no others."""
    monkeypatch.setattr(jaccard_join, "PART", 5)
    rng = random.Random(19)
    rows = [(rng.randrange(3), g, bytes([g % 250, g // 250]), rng.choice([9, 10, 11, 12, 50, 55, 100, 101, 1000]), rng.randrange(3), bytes([rng.randrange(4)])) for g in range(260)]
    df = spark.createDataFrame(rows, "list bigint, group bigint, set binary, size int, at int, root binary")
    for num in (80, 90):
        want = set()
        for x, a in enumerate(rows):
            for b in rows[x + 1 :]:
                small, large = sorted((a[3], b[3]))
                if a[0] == b[0] and a[5] != b[5] and 100 * small >= num * large and min(a[3] - a[4], b[3] - b[4]) >= -(-num * (a[3] + b[3]) // (num + 100)):
                    want.add((a[1], b[1], a[2], b[2]))
        assert {(r.g, r.h, bytes(r.a), bytes(r.b)) for r in jaccard_join._across(df, num, 100).collect()} == want


def test_keep_one(docs, rows):
    kept = [(r.doc_id, r.text) for r in jaccard_join.keep_one(docs).collect()]
    want = brute_components(rows, 5, 80, 100)
    classes = {c for _, n, c in want if n}
    # id 3 is the least of two classes: "one" and "another three"
    assert len(kept) == len(classes) + 1 + sum(1 for _, t in set(rows) if not WORD.search(t or ""))
    assert jaccard_join.keep_one(docs).columns == docs.columns


def test_components_of_a_path(spark):
    n = 70
    links = spark.createDataFrame([(bytes([i]), bytes([i + 1])) for i in range(n)] + [(b"\xf0", b"\xf1"), (b"\xf1", b"\xf1")], "a binary, b binary")
    found = {bytes(r.node): bytes(r.root) for r in jaccard_join.components(links).collect()}
    assert found == {**{bytes([i]): b"\0" for i in range(1, n + 1)}, b"\xf1": b"\xf0"}


# 3


def test_fertility(docs, rows):
    found = {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in fertility.quality_digest(docs).collect()}
    want = set()
    for key, t in rows:
        t = t or ""
        w = WORD.findall(t)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        c = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        cover = {j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        want.add((key, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover), len(w) < 20 or 100 * len(cover) > 30 * len(w)))
    assert found == want
    assert fertility.quality_digest(empty(docs)).count() == 0


RUNNING = {
    "latin": "Language is a system that people use to talk with one another. Every country has its own history, and the texts that were written there show how its inhabitants lived, what they believed and how they worked. The books of the library are open to all visitors every day except on Sundays, and may be taken home for two weeks at a time.",
    "greek": "Η γλώσσα είναι ένα σύστημα που χρησιμοποιούν οι άνθρωποι για να επικοινωνούν μεταξύ τους. Κάθε χώρα έχει τη δική της ιστορία, και τα κείμενα που γράφονται σε αυτή δείχνουν πώς ζούσαν, τι πίστευαν και με ποιον τρόπο δούλευαν όσοι κατοικούσαν εκεί. Τα βιβλία της βιβλιοθήκης είναι ανοιχτά για όλους τους επισκέπτες κάθε μέρα εκτός από την Κυριακή.",
    "cyrillic": "Язык представляет собой систему, которой люди пользуются для общения друг с другом. У каждой страны есть своя история, и тексты, написанные в ней, показывают, как жили, во что верили и чем занимались те, кто там обитал. Книги в библиотеке открыты для всех посетителей каждый день, кроме воскресенья, и взять их домой можно на две недели.",
    "cjk": "语言 是 人们 用来 互相 交流 的 系统。 每个 国家 都有 自己 的 历史， 那里 写下 的 文字 说明 当时 的 人 怎样 生活、 相信 什么 以及 如何 工作。 图书馆 的 书 每天 向 所有 来访者 开放， 星期日 除外， 可以 借 回家 两个 星期。 城市 里 还有 许多 小 书店 和 安静 的 咖啡馆。",
    "other": "اللغة نظام يستخدمه الناس للتواصل فيما بينهم. لكل بلد تاريخه الخاص، والنصوص التي كتبت فيه تبين كيف عاش سكانه وماذا كانوا يعتقدون وكيف كانوا يعملون. كتب المكتبة مفتوحة لجميع الزوار كل يوم ما عدا يوم الأحد ويمكن استعارتها إلى البيت لمدة أسبوعين كاملين.",
}


def test_fertility_verdicts(spark, rows):
    """The rule again in plain Python, on all kinds of texts; running text of each script stays, soup and pasted codes go."""
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=cluster.tokenizer_file("piece_bpe_32k.model"))
    soup = {"hex": " ".join(f"{i * 7919 * 104729 * 65537 % 2**64:016x}" for i in range(1, 60)), "signs": " ".join("{}[]~^`@"[i % 7 :] for i in range(90)), "loop": "the same five words again " * 60}
    texts = [t or "" for _, t in rows] + list(RUNNING.values()) + list(soup.values())
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r.doc_id: r for r in fertility.quality_digest(df).collect()}
    scripts = [("latin", 0x41, 0x250), ("greek", 0x370, 0x400), ("cyrillic", 0x400, 0x530), ("cjk", 0x3000, 0xD7FF)]

    def verdict(t, r):
        ids = lib.encode(t)
        if r.base_failed or not ids:
            return False
        c = collections.Counter(ids)
        entropy = -sum(n / len(ids) * math.log2(n / len(ids)) for n in c.values())
        low, high, share, relief = fertility.BANDS[r.script]
        points = fertility.LEAST_ENTROPY
        least = points[-1][1]
        for (a, x), (b, y) in zip(points, points[1:]):
            if a <= len(ids) < b:
                least = x + (math.log2(len(ids)) - math.log2(a)) * (y - x) / (math.log2(b) - math.log2(a))
        return low <= len(t) / len(ids) <= high and sum(map(lib.is_byte, ids)) / len(ids) <= share and entropy >= least - relief

    for i, t in enumerate(texts):
        assert found[i].kept == verdict(t, found[i]), t[:40]
        letters = [next((s for s, a, b in scripts if a <= ord(c) < b), None) for c in t if c.isalpha() and ord(c) < 0x530]
        if letters and len(set(letters)) == 1:
            assert found[i].script == letters[0]
    at = len(rows)
    assert [(found[at + i].script, found[at + i].kept) for i in range(len(RUNNING))] == [(s, True) for s in RUNNING]
    assert not any(found[at + len(RUNNING) + i].kept for i in range(len(soup)))


def test_fertility_of_tokens():
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=cluster.tokenizer_file("piece_bpe_32k.model"))
    texts = [t or "" for t in TEXTS[:29]]
    got = fertility.fertility_counts(texts, cluster.tokenizer_file("piece_bpe_32k.model"))
    for i, t in enumerate(texts):
        ids = lib.encode(t)
        c = collections.Counter(ids)
        assert got["n_tokens"][i] == len(ids) and got["n_byte"][i] == sum(map(lib.is_byte, ids))
        assert got["entropy"][i] == pytest.approx(-sum(n / len(ids) * math.log2(n / len(ids)) for n in c.values()), abs=1e-9)


# 4


def brute_contamination(rows, items, window):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    found = {}
    for key, t in items:
        w = pattern.findall(low(t or ""))
        k = min(window, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            found.setdefault(tuple(w[i : i + k]), set()).update({str(key)} if key is not None else set())
    sizes = {len(x) for x in found}
    out = []
    for key, t in rows:
        w = pattern.findall(low(t or ""))
        hit, names = set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in found:
                    hit.update(range(i, i + k))
                    names |= found[tuple(w[i : i + k])]
        out.append((key, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes", [decontaminate.BLOCK_BYTES, 200])
def test_contamination(spark, docs, rows, block_bytes, monkeypatch):
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    found = decontaminate.find_contamination(docs, bench, ["doc_id"], block_bytes=block_bytes)
    hit = F.expr("aggregate(hit_words, 0L, (a, s) -> a + s.end - s.start)")
    got = table(found.select("doc_id", "n_words", hit, F.size("hit_items").cast("bigint"), F.sha2(F.array_join("hit_items", ","), 256), F.size("hit_words") > 0))
    assert got == brute_contamination(rows, ITEMS, 10)


def test_contamination_of_long_items_only(spark, docs, rows):
    items = [i for i in ITEMS if i[0] in (0, 1, None) and i[1]]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    assert table(decontaminate.contamination_digest(docs, bench)) == brute_contamination(rows, items, 10)
    none = bench.where("false")
    assert table(decontaminate.contamination_digest(docs, none)) == brute_contamination(rows, [], 10)
    assert decontaminate.contamination_digest(empty(docs), bench).count() == 0


def test_remove_spans(spark, docs):
    bench = spark.createDataFrame([i for i in ITEMS if i[0] in (0, 1)], "item_id bigint, text string")
    out = decontaminate.remove_spans(docs, bench)
    assert out.columns == docs.columns
    texts = [(r.doc_id, r.text) for r in out.collect()]
    assert not any(c[5] for c in brute_contamination(texts, [i for i in ITEMS if i[0] in (0, 1)], 10))
    assert {t for _, t in texts} >= {BASE, None, ""}  # clean ones as they were


def test_suffix_automaton_is_small():
    """Flat arrays, of which even all items of a block take little."""
    import pickle

    rng = random.Random(5)
    items = [(str(i), [b"w%d" % rng.randrange(20_000) for _ in range(200)]) for i in range(300)]
    n_bytes = sum(len(w) + 1 for _, ws in items for w in ws)
    automaton = decontaminate.SuffixAutomaton(items, 10)
    assert len(pickle.dumps(automaton)) < 16 * n_bytes
    assert [(a, b, [automaton.names[i] for i in k]) for a, b, k in automaton.stream(items[7][1][:12])] == [(0, 10, ["7"]), (1, 11, ["7"]), (2, 12, ["7"])]


def test_suffix_automaton_on_random_words():
    rng = random.Random(2)
    for _ in range(60):
        items = [(str(i), [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(1, 9))]) for i in range(5)]
        words = [rng.choice([b"a", b"b", b"c", b"z"]) for _ in range(60)]
        automaton = decontaminate.SuffixAutomaton(items, 4)
        got = {(a, b, frozenset(automaton.names[i] for i in k)) for a, b, k in automaton.stream(words)}
        hits = collections.defaultdict(set)
        for key, w in items:
            k = min(4, len(w))
            for i in range(len(w) - k + 1):
                for j in range(len(words) - k + 1):
                    if words[j : j + k] == w[i : i + k]:
                        hits[j, j + k].add(key)
        assert {(a, b) for a, b, _ in got} == set(hits)
        for (a, b), names in hits.items():
            assert set().union(*[k for x, y, k in got if (x, y) == (a, b)]) >= names


# 5


def test_warc(spark):
    pages = [(1, "http://a", "<p>x</p>"), (2, "http://b", "<p>x</p>"), (3, None, None), (4, "u\r\nbad", ""), (5, "é", "ü" * 3000), (2, "http://b", "<p>x</p>"), (None, "n", "<p>x</p>"), (9, "z", prose(5000))]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("_sha1", F.lit("clash"))
    import base64

    first = {}
    for key, _, html in pages:
        if key is not None:
            first[html or ""] = min(key, first.get(html or "", key))
    want = []
    for key, _, html in pages:
        body = (html or "").encode()
        one = first[html or ""]
        want.append((key, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if key == one else "revisit", None if key == one else one))
    assert table(warc.warc_digest(df)) == sorted(want, key=str)
    assert warc.warc_digest(df.where("false")).count() == 0


def test_warc_of_a_long_url(spark):
    url = "data:text/html;base64," + "QUJD" * 25_000
    found = warc.parse(warc.record(1, url, b"<p>x</p>"))
    assert found["headers"]["warc-target-uri"] == url and found["payload"] == b"<p>x</p>"
    df = spark.createDataFrame([(1, url, "<p>x</p>"), (2, "http://b", "<p>x</p>")], "page_id bigint, url string, html string")
    assert [(r.page_id, r.payload_bytes, r.record_type) for r in warc.warc_digest(df).orderBy("page_id").collect()] == [(1, 8, "response"), (2, 8, "revisit")]


def test_warc_of_hot_payloads_and_text_ids(spark, monkeypatch):
    """Copies of a payload that many rows have meet no join; ids of any text come back as they were."""
    monkeypatch.setattr(warc, "HOT_SHARE", 4)
    ids = ["None", "a>b", "c\r\nd", "", "é %41", None, *(f"p{i:03}" for i in range(60))]
    pages = [(k, "u", "" if i % 3 == 0 else "<p>same</p>" if i % 3 == 1 else f"<p>{i // 6}</p>") for i, k in enumerate(ids)]
    pages += [(None, "u", "none"), (None, "u", "none"), ("x", "u", None)]
    df = spark.createDataFrame(pages, "page_id string, url string, html string").repartition(3)
    first = {}
    for key, _, html in pages:
        if key is not None:
            first[html or ""] = min(key, first.get(html or "", key))
    want = [(key, len((html or "").encode()), "response" if key == (one := first.get(html or "")) or one is None else "revisit", None if key == one else one) for key, _, html in pages]
    assert sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.warc_digest(df).collect()), key=str) == sorted(want, key=str)


def test_warc_frames_of_others():
    """Skippable frames anywhere, a plain dictionary, frames without a content size, and frames that expand too far."""
    import struct

    import zstandard

    records = [warc.record(i, f"http://x/{i}", (f"<html>{i}" + prose(60)).encode()) for i in range(400)]
    trained = zstandard.train_dictionary(8 << 10, records)
    packer = zstandard.ZstdCompressor(dict_data=trained, write_content_size=False)
    skip = struct.pack("<II", 0x184D2A53, 5) + b"other"
    data = struct.pack("<II", warc.DICTIONARY_MAGIC, len(trained.as_bytes())) + trained.as_bytes() + skip + b"".join(packer.compress(r) + skip for r in records)
    assert list(warc.frames(io.BytesIO(data))) == records
    bomb = zstandard.ZstdCompressor().compress(records[0][:-4] + b"\0" * (1 << 28))
    with pytest.raises(warc.WarcError, match="over"):
        list(warc.frames(io.BytesIO(bomb)))
    with pytest.raises(warc.WarcError, match="over 100 bytes"):
        list(warc.frames(io.BytesIO(data), most=100))
    with pytest.raises(warc.WarcError):
        list(warc.frames(io.BytesIO(skip[:-2])))
    big = [warc.record(1, "u", np.random.default_rng(0).bytes(3 << 20)), records[3]]
    assert list(warc.frames(io.BytesIO(b"".join(zstandard.ZstdCompressor().compress(r) for r in big)))) == big


def test_warc_frames_and_damage():
    a = warc.Archive()
    records = [warc.record(i, f"http://x/{i}", (f"<html>{i}" + prose(300)).encode()) for i in range(300)]
    for r in records:
        a.add(r)
    data = a.to_bytes()
    assert data[:4] == (0x184D2A5D).to_bytes(4, "little")
    assert list(warc.frames(io.BytesIO(data))) == records
    assert warc.parse(records[7])["payload"].startswith(b"<html>7")
    with pytest.raises(warc.WarcError):
        list(warc.frames(io.BytesIO(data[:-9])))
    with pytest.raises(warc.WarcError):
        warc.parse(records[0].replace(b"<html>", b"<HTML>"))
    with pytest.raises(warc.WarcError):
        warc.parse(records[0][:-5])
    assert list(warc.frames(io.BytesIO(b""))) == []


# 6


def test_repair_shards(docs, rows):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(cluster.tokenizer_file("word_bpe_49k.json"))
    want, start = [], 0
    packed = []
    for key, t in rows:
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        packed.append((key is not None, key or 0, zlib.crc32(ids.astype("<u2").tobytes()), ids))
    for known, key, _, ids in sorted(packed, key=lambda x: x[:3]):
        want.append((key if known else None, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(table(repair_codec.shard_digest(docs)), key=lambda r: r[1]) == want
    assert repair_codec.shard_digest(empty(docs)).count() == 0


def test_repair_random_access():
    rng = np.random.default_rng(4)
    words = [rng.integers(0, 500, rng.integers(1, 6)) for _ in range(40)]
    texts = [np.concatenate([words[i] for i in rng.integers(0, 40, rng.integers(1, 400))]) for _ in range(60)] + [np.zeros(0, np.int64), np.array([7])]
    ids, lens = np.concatenate(texts), np.array([len(t) for t in texts])
    seq, rules, symbols = repair_codec.compress(ids, lens, 500, pairs=64)
    assert len(rules) and len(seq) < len(ids) / 2
    shard = repair_codec.Shard.from_bytes(repair_codec.Shard(500, rules, seq, symbols, lens, pa.array(np.arange(len(lens)))).to_bytes())
    assert (shard.decode(shard.seq) == ids).all()
    for _ in range(50):
        a, b = sorted(rng.integers(0, len(ids), 2).tolist())
        assert (shard.span(a, b) == ids[a:b]).all()
    heads = np.cumsum(symbols) - symbols
    for d, t in enumerate(texts):  # no rule crosses a document's end
        assert (shard.decode(shard.seq[heads[d] : heads[d] + symbols[d]]) == t).all()
    data = bytearray(shard.to_bytes())
    data[40] ^= 1
    with pytest.raises(ValueError):
        repair_codec.Shard.from_bytes(bytes(data))


def test_repair_goes_on_while_it_pays():
    """Equal documents shrink to few symbols each: rules nest as deep as they have to, and symbols take more than 16 bits."""
    rng = np.random.default_rng(5)
    text = rng.integers(0, 65500, 512)
    ids, lens = np.tile(text, 200), np.full(200, 512)
    seq, rules, symbols = repair_codec.compress(ids, lens, 65500)
    assert len(seq) <= 4 * 200 and 65500 + len(rules) > 1 << 16
    shard = repair_codec.Shard.from_bytes(repair_codec.Shard(65500, rules, seq, symbols, lens, pa.array(np.arange(200))).to_bytes())
    assert (shard.decode(shard.seq) == ids).all() and (shard.span(700, 1300) == ids[700:1300]).all()
    # pairs that share a bin with one that comes later and is rare
    bins = lambda a, b: (np.array([a << 32 | b]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - repair_codec._BINS)).item()
    a = next(x for x in range(10, 1 << 22) if bins(x, x + 1) == bins(7, 8))
    ids = np.array([7, 8] * 100 + [a, a + 1])
    seq, rules, _ = repair_codec.compress(ids, np.array([2] * 101), 1 << 22)
    assert rules.tolist() == [[7, 8]] and len(seq) == 102


@pytest.mark.parametrize("bins", [20, 6])
def test_repair_leaves_no_frequent_pair(bins, monkeypatch):
    """At the end no pair of a document's neighbouring symbols occurs as often as a rule takes; many pairs in a bin or few."""
    monkeypatch.setattr(repair_codec, "_BINS", bins)
    rng = np.random.default_rng(9)
    for alphabet, n in ((2, 3000), (30, 20000), (400, 60000)):
        ids = rng.zipf(1.4, n) % alphabet
        lens = np.diff(np.unique(np.concatenate([[0, n], rng.integers(0, n, 40)])))
        seq, rules, symbols = repair_codec.compress(ids, lens, alphabet, pairs=64)
        shard = repair_codec.Shard(alphabet, rules, seq, symbols, lens, pa.array(np.arange(len(lens))))
        assert (shard.decode(seq) == ids).all() and (np.bincount(seq, minlength=alphabet + len(rules)) + np.bincount(rules.ravel(), minlength=alphabet + len(rules)))[alphabet:].all()
        inner = np.ones(len(seq), bool)
        inner[np.cumsum(symbols) - 1] = False
        left = seq[np.flatnonzero(inner)] << 32 | seq[np.flatnonzero(inner) + 1]
        # of a symbol next to itself every other place counts, so its pairs may be left
        left = left[left >> 32 != left & 0xFFFFFFFF]
        assert not len(left) or np.unique(left, return_counts=True)[1].max() < repair_codec.LEAST


def test_repair_of_text_ids_and_first_places(spark, monkeypatch):
    monkeypatch.setattr(repair_codec, "_GROUP", 2)
    listed = spark.createDataFrame([(p, s, f"f{p}.{s}", 1, 10 * p + s + 1) for p in range(7) for s in range(3)], "part bigint, seq bigint, path string, n_docs bigint, n_tokens bigint")
    start = 0
    for r in repair_codec.first_places(listed).orderBy("part", "seq").collect():
        assert r["first"] == start
        start += r.n_tokens
    df = spark.createDataFrame([("b", "two words"), (None, "none"), ("a", "one"), ("10", "ten")], "doc_id string, text string")
    assert [(r.doc_id, r.start, r.n_tokens) for r in repair_codec.shard_digest(df).orderBy("start").collect()] == [(None, 0, 2), ("10", 2, 2), ("a", 4, 2), ("b", 6, 3)]


def test_word_encoder_forgets(monkeypatch):
    monkeypatch.setattr(repair_codec, "_CACHE", 50)
    enc = repair_codec.WordEncoder(cluster.tokenizer_file("word_bpe_49k.json"))
    texts = [prose(80) + "... it's 3,000 O'Neil's x's!? Ünïcödé" for _ in range(20)]
    for t in texts:
        ids, lens = enc(pa.array([t]))
        assert ids.tolist() == enc.lib.encode(t, add_special_tokens=False).ids and lens.tolist() == [len(ids)]


def test_word_encoder_of_a_word_of_a_million_tokens():
    enc = repair_codec.WordEncoder(cluster.tokenizer_file("word_bpe_49k.json"))
    texts = ["start 12 end", "7" * ((1 << 20) + 5), "漢字 " + "0123456789" * 110_000 + " tail"]
    for _ in range(2):  # learnt, and from the cache
        ids, lens = enc(pa.array(texts))
        at = 0
        for t, n in zip(texts, lens.tolist(), strict=True):
            assert ids[at : at + n].tolist() == enc.lib.encode(t, add_special_tokens=False).ids
            at += n
        assert at == len(ids) and max(lens) > 1 << 20


def test_word_encoder_against_library():
    """Letters of ASCII and Latin-1 in both cases, signs and digits beside them, letters that change under normalisation,
    long words, long tails and control characters; in one batch, one by one, and from the cache."""
    enc = repair_codec.WordEncoder(cluster.tokenizer_file("word_bpe_49k.json"))
    rng = np.random.default_rng(11)
    common = [*"abcxyzABÉéèßÿÞþÀöñ.,!?'-# 0123\t\n"]
    odd = [*"×÷ªµºİıſΣσςǅﬁ漢字한𝒜e\u0301\u0327\u1100\u1161\u00a0\u0085\u2028\x00\x07\x1c<|>\u200d", "'s", "'LL", "<|endoftext|>", "x" * 70, "é" * 40, "#" * 12, "É" + "*" * 9, "abcdefgh", "abcdefg\x08", "abcdefg"]
    texts = ["", "a", "É", "été. Été, ÉTÉ! été...... été.........", *["".join(rng.choice(common if i % 2 else common + odd, rng.integers(0, 60))) for i in range(600)]]
    want = [enc.lib.encode(t, add_special_tokens=False).ids for t in texts]
    plain = [i for i, t in enumerate(texts) if "<|" not in t]  # special strings have a batch treated otherwise
    for chosen in ([*range(len(texts))], plain, plain, *[[i] for i in range(len(texts))]):
        ids, lens = enc(pa.array([texts[i] for i in chosen]))
        assert ids.tolist() == [x for i in chosen for x in want[i]] and lens.tolist() == [len(want[i]) for i in chosen]


def test_word_encoder_asks_little():
    """A word is asked for once, whatever signs follow its last letter; letters of ASCII and Latin-1 take no expressions."""
    enc = repair_codec.WordEncoder(cluster.tokenizer_file("word_bpe_49k.json"))
    asked = {"all": [], "letters": []}

    class Asked:
        def __init__(self, lib, kind):
            self.lib, self.kind = lib, kind

        def encode_batch_fast(self, texts, **how):
            asked[self.kind] += " ".join(texts).replace(enc.mark, " ").split()
            return self.lib.encode_batch_fast(texts, **how)

    text = "été été. word, Straße! straße; où? où word"
    want = enc.lib.encode(text, add_special_tokens=False).ids
    enc.lib, enc.letters_lib = Asked(enc.lib, "all"), Asked(enc.letters_lib, "letters")
    for _ in range(2):
        assert enc(pa.array([text]))[0].tolist() == want
    assert sorted(asked["letters"]) == ["où", "straße", "word", "été"] and sorted(asked["all"]) == ["!", ",", ".", ";", "?"]


def test_word_table():
    """Hashes that share places, up to the last one and round to the first; the table grows when half of it is taken."""
    rng = np.random.default_rng(12)
    table = repair_codec.WordTable(8)
    keys = np.unique(np.concatenate([rng.integers(1, 1 << 64, 3000, dtype=np.uint64), np.arange(1, 200, dtype=np.uint64), np.uint64(2**64 - 1) - np.arange(200, dtype=np.uint64)]))
    rng.shuffle(keys)
    for a in range(0, len(keys), 97):
        table.add(keys[a : a + 97], np.arange(a, min(a + 97, len(keys))))
        assert table.get(keys).tolist() == [*range(min(a + 97, len(keys)))] + [-1] * max(0, len(keys) - a - 97)
    assert 2 * table.used <= len(table.keys) and table.used == len(keys)


# 7


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
@pytest.mark.parametrize(("chunk", "overlap"), [(64, 16), (300, 8), (8192, 256)])
def test_token_counts(name, chunk, overlap):
    enc = token_counts.encoder(cluster.tokenizer_file(name))
    assert enc.splits
    for t in [x or "" for x in TEXTS] + ["a  b\n\n c   d " * 40, "<|endoftext|>" * 30 + " x " * 30]:
        if len(t) > chunk and len(t) < 60000:
            assert enc.count_huge(t, chunk, overlap) == enc.counts([t])[0]


def test_token_counts_of_texts_without_spaces():
    """Linear in the text: no stretch is encoded over and over, whether it has places to splice or none."""
    rng = random.Random(14)
    cjk = "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(100_000))
    stops = "".join(c + ("。" if i % 97 == 0 else "\n" if i % 1013 == 0 else "") for i, c in enumerate(cjk))
    far = cjk[:30_000] + " x" + cjk[:30_000] + " yz " + cjk[:9000]
    lone = "<|endoftext|>" + cjk[:20_000] + "<|endoftext|>a\n" + cjk[:20_000] + "don't\n'll\n" + cjk[:9000]
    for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"):
        enc = token_counts.encoder(cluster.tokenizer_file(name))
        for t in (cjk, stops, far, lone, "7" * 50_000, "a" * 50_000):
            seen = []

            def starts(x, enc=enc, seen=seen):
                seen.append(len(x))
                return enc.starts(x)

            assert enc.count_huge(t, encode=starts) == enc.counts([t])[0]
            assert sum(seen) < 2.5 * len(t) + 20_000
    enc = token_counts.encoder(cluster.tokenizer_file("byte_bpe_50k.json"))
    assert enc.count_huge(cjk * 10) == enc.counts([cjk * 10])[0]


def test_token_count_rows(docs, rows):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(cluster.tokenizer_file("byte_bpe_50k.json"))
    want = [(key, len((t or "").encode()), n := len(lib.encode(t or "", add_special_tokens=False)), n > 512) for key, t in rows]
    assert table(token_counts.count_digest(docs)) == sorted(want, key=str)
    assert token_counts.count_digest(empty(docs)).count() == 0


# 8


def brute_windows(rows, k):
    words = [WORD.findall(t or "") for _, t in rows]
    c = collections.Counter(tuple(w[i : i + k]) for w in words for i in range(len(w) - k + 1))
    out = []
    for (key, _), w in zip(rows, words, strict=True):
        gone = {j for i in range(len(w) - k + 1) if c[tuple(w[i : i + k])] > 1 for j in range(i, i + k)}
        kept = [x for j, x in enumerate(w) if j not in gone]
        out.append((key, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("k", "m"), [(35, 8), (5, 2), (9, 9)])
def test_window_dedup(docs, rows, k, m):
    assert table(window_dedup.dedup_digest(docs, k, m)) == brute_windows(rows, k)


@pytest.mark.parametrize("parts", [1, 6])
def test_window_dedup_of_a_common_passage(spark, parts):
    """A passage that most texts share, each with other words around it."""
    rng = random.Random(41)
    rows = [(i, prose(rng.randrange(60), rng) + " " + PASSAGE + " " + prose(rng.randrange(60), rng)) for i in range(120)]
    rows += [(200 + i, prose(150, rng)) for i in range(20)] + [(300, rows[0][1]), (301, rows[0][1]), (302, PASSAGE + " " + PASSAGE)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts)
    assert table(window_dedup.dedup_digest(df)) == brute_windows(rows, 35)


def test_window_dedup_of_looped_texts(spark):
    """Near copies of a line that goes on for long: runs with equal ends and lengths that differ between them."""
    rng = random.Random(12)
    rows = []
    for i in range(40):
        words = (prose(rng.randrange(5, 26), rng).split()) * 40
        at = len(words) // 2 + rng.randrange(-9, 10)
        for j in range(2):
            rows.append((2 * i + j, " ".join([*words[:at], f"odd{i}x{j}", *words[at + 1 :]])))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    assert table(window_dedup.dedup_digest(df)) == brute_windows(rows, 35)


def test_window_dedup_of_nothing(docs):
    assert window_dedup.dedup_digest(empty(docs)).count() == 0


def test_remove_repeats(docs):
    out = window_dedup.remove_repeats(docs)
    assert out.columns == docs.columns
    texts = [(r.doc_id, r.text) for r in out.collect()]
    assert all(PASSAGE not in (t or "") and t != BASE for _, t in texts)
    assert {t for _, t in texts} >= {None, "", "a b c", "a" * 20000}


# 9


def test_language_id(spark):
    rng = random.Random(6)
    own = {lang: ["".join(rng.choice(letters) for _ in range(3)) for _ in range(40)] for lang, letters in (("aa", "abcde"), ("bb", "defgh"), ("cc", "ghijk"))}
    rows = [(i, " ".join(rng.choice(own[lang]) for _ in range(40)), lang) for i, lang in enumerate(list(own) * 60)]
    odd = [(1000, None, "aa"), (1001, "", "bb"), (1002, "123 --- 456", "cc"), (1003, "x" * 50000, None), (None, rows[0][1], "bb"), (1004, "漢字漢字", None)]
    df = spark.createDataFrame(rows + odd, "doc_id bigint, text string, lang string").withColumn("_body", F.lit(1)).withColumn("_lang", F.lit("x"))
    found = {r.doc_id: r for r in language_id.language_digest(df).collect()}
    assert len(found) == len(rows) + len(odd)
    held = [(i, lang) for i, _, lang in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(found[i].lang_pred == lang for i, lang in held) >= 0.95 * len(held) and all(found[i].held_out for i, _ in held)
    for i in (1000, 1001, 1002):
        assert (found[i].lang_pred, found[i].score) == ("und", 0.0)
    assert found[1004].lang_pred in own and all(0 <= r.score <= 1 for r in found.values())
    nothing = language_id.language_digest(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in nothing} == {"und"}
    assert language_id.language_digest(df.where("false")).count() == 0
    kept = language_id.keep_identified(df)
    assert kept.columns == df.columns and {1000, 1001, 1002}.isdisjoint({r.doc_id for r in kept.collect()}) and kept.count() >= len(rows)


def test_presence_kernel_and_ridge():
    """Presence rows against sets of n-grams, the kernel against their intersections, and the machines against a dense solve."""
    texts = ["Abc abd", "", "xyz 12", "Äbc", "abc abd abc", "the quick brown fox jumps", "der schnelle braune fuchs springt", "lazy dogs sleep all day", "faule hunde schlafen den ganzen tag"]
    x = language_id.presence(pa.array(texts))

    def places(t):
        b = bytearray(t.encode())
        for i in range(1, len(b)):
            if b[i - 1] == 0xC3 and 0x80 <= b[i] <= 0x9E and b[i] != 0x97:
                b[i] += 0x20
        b = bytes(c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 97 <= c <= 122 else 32 for c in b)
        out = set()
        for n in (1, 2, 3):
            for i in range(len(b) - n + 1):
                code = int.from_bytes(b[i : i + n], "big") + (n << 28)
                out.add((code * 2654435761 % 2**32) >> (32 - language_id.DIMENSIONS.bit_length() + 1))
        return out

    sets = [places(t) for t in texts]
    assert [set(np.flatnonzero(r).tolist()) for r in x] == sets
    k = language_id._kernel(x, x)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert k[i, j] == pytest.approx(len(a & b) / math.sqrt(max(1, len(a)) * max(1, len(b))), abs=1e-6)
    # with every row a landmark the machines are ridge regression on K^(1/2)
    own = x[5:]
    labels = ["en", "de", "en", "de"]
    m = language_id.fit(np.packbits(own.astype(bool), axis=1), labels, landmarks=4, ridge=1e-2)
    order = [1, 3, 0, 2]  # landmarks stand by language
    kk = language_id._kernel(own, own).astype(np.float64)
    y = np.array([[1.0 if lab == lang else -1.0 for lang in ("de", "en")] for lab in labels]) / 2  # each language's rows weigh one together
    values, vectors = np.linalg.eigh(kk[np.ix_(order, order)])
    z = kk[:, order] @ (vectors / np.sqrt(values))
    want = z @ np.linalg.solve(z.T @ z / 2 + 1e-2 * np.eye(4), z.T @ y)
    assert m.languages == ["de", "en"] and m.scores(own) == pytest.approx(want, abs=1e-4)
    # of equal scores the alphabetically first language
    m.weights[:] = 0
    assert m.scores(own).argmax(axis=1).tolist() == [0] * 4


def test_texts_like_no_language_go(spark):
    """Other scripts, other languages and gibberish of any length go; clean texts stay, short, mixed and unlabelled ones too."""
    rng = random.Random(16)
    own = {
        "en": "the and that there was with from this which would other about people into water over then them these some could".split(),
        "de": "der und die das nicht ein ich sie mit auf für ist von dem auch werden haben über straße größe könnte zwischen".split(),
    }
    make = lambda lang, n: " ".join(rng.choice(own[lang]) for _ in range(n))
    rows = [(i, make(lang, 8 + i), lang) for i, lang in enumerate(["en", "de"] * 60)]
    rows += [(200, make("en", 3), None), (201, make("de", 5000), None), (202, make("en", 60) + " " + make("de", 20), None), (203, make("en", 80) + " token = 0cf1bbc67ab3", "en")]
    code = "def f(x):\n    return [y ** 2 for y in x if y % 3 == 0 or not y]\n\nclass Q(P):\n    z: int = 0x1F\n"
    odd = ["漢字の文章を判別する試験です。" * 9, "Это проверочный текст на русском языке. " * 5, "هذا نص تجريبي باللغة العربية " * 5, "x" * 50000, rng.randbytes(900).hex(), "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.", " ".join("".join(rng.choice("bcdfgjkpqvxyz") for _ in range(6)) for _ in range(300)), code * 4]
    df = spark.createDataFrame(rows + [(1000 + i, t, None) for i, t in enumerate(odd)], "doc_id bigint, text string, lang string")
    assert {r.doc_id for r in language_id.keep_identified(df).collect()} == {r[0] for r in rows}


# 10


def test_sentence_fst_equals_the_library(docs, rows):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=cluster.tokenizer_file("piece_bpe_32k.model"))
    want = []
    for key, t in rows:
        ids = lib.encode(t or "")
        want.append((key, len(ids), sum(map(lib.is_byte, ids)), zlib.crc32(np.array(ids, "<u4").tobytes()), lib.decode(ids) == (t or "")))
    assert table(sentence_fst.piece_digest(docs)) == sorted(want, key=str)
    assert sentence_fst.piece_digest(empty(docs)).count() == 0
    fst = sentence_fst.transducer(cluster.tokenizer_file("piece_bpe_32k.model"))
    rng = random.Random(1)
    for _ in range(3000):
        t = "".join(rng.choice("abcdefgh  \n\té€▁𝄞<>0x.,;'\"漢字ки​") for _ in range(rng.randrange(50)))
        ids = fst.encode(pa.array([t]))[0]
        assert ids.tolist() == lib.encode(t) and fst.decode(ids) == lib.decode(lib.encode(t))


def toy_model(pieces, kind):
    """A SentencePiece model file: control pieces, all byte pieces, and the given (piece, score)."""
    import struct

    number = lambda n: bytes([n]) if n < 128 else bytes([n & 127 | 128]) + number(n >> 7)
    field = lambda k, x: number(k << 3 | 2) + number(len(x)) + x
    flag = lambda k, x: number(k << 3) + number(x)
    piece = lambda p, score, t: field(1, field(1, p.encode()) + number(2 << 3 | 5) + struct.pack("<f", score) + flag(3, t))
    out = piece("<unk>", 0, 2) + piece("<s>", 0, 3) + piece("</s>", 0, 3)
    out += b"".join(piece(f"<0x{b:02X}>", 0, 6) for b in range(256)) + b"".join(piece(p, x, 1) for p, x in pieces)
    return out + field(2, flag(3, kind) + flag(35, 1)) + field(3, field(1, b"identity") + flag(3, 1) + flag(4, 0) + flag(5, 1))


@pytest.mark.parametrize("kind", [sentence_fst.UNIGRAM, sentence_fst.BPE])
def test_toy_models(tmp_path, kind):
    """Models of a few pieces against the library and, for unigram ones, against all paths."""
    import sentencepiece

    rng = random.Random(kind)
    for turn in range(12):
        letters = ["▁", *"abcé"]
        made = dict.fromkeys(letters)
        while len(made) < 30:
            p = "".join(rng.choice(letters[1:]) for _ in range(rng.randrange(2, 5)))
            made[rng.choice(["", "▁"]) + p] = None
        pieces = [(p, -(1 + i) - rng.random() / 2 if kind == sentence_fst.UNIGRAM else -float(i)) for i, p in enumerate(made)]
        (tmp_path / f"{turn}.model").write_bytes(toy_model(pieces, kind))
        lib = sentencepiece.SentencePieceProcessor(model_file=str(tmp_path / f"{turn}.model"))
        fst = sentence_fst.Transducer(str(tmp_path / f"{turn}.model"))
        for _ in range(150):
            t = "".join(rng.choice("aabbccé xé漢") for _ in range(rng.randrange(70)))
            assert fst.encode(pa.array([t]))[0].tolist() == lib.encode(t), t
            word = "▁" + t[:7].replace(" ", "")
            assert (list(fst._rest(None, word)) if kind == sentence_fst.BPE else fst.path(word)) == (fst._best_first(word) if kind == sentence_fst.BPE else fst._in_order(word))
            if kind == sentence_fst.UNIGRAM:
                weight = lambda parts, fst=fst: sum(-fst.scores.get(p, fst.least) for p in parts)
                possible = [parts for parts in _splits(word) if all(p in fst.scores or len(p) == 1 for p in parts)]
                assert weight([fst._spelled(x) for x in fst.path(word)]) == pytest.approx(min(map(weight, possible)))


def test_sentence_fst_caches_are_bounded(monkeypatch):
    import sentencepiece

    monkeypatch.setattr(sentence_fst, "_CACHE_BYTES", 2000)
    monkeypatch.setattr(sentence_fst, "_PAIRS", 40)
    monkeypatch.setattr(sentence_fst, "_RESTS", 40)
    path = cluster.tokenizer_file("piece_bpe_32k.model")
    lib, fst = sentencepiece.SentencePieceProcessor(model_file=path), sentence_fst.Transducer(path)
    for _ in range(60):
        t = prose(30) + " " + "漢" * RNG.randrange(3000)
        assert fst.encode(pa.array([t]))[0].tolist() == lib.encode(t)
        assert len(fst.pairs) <= 41 and len(fst.rests) <= 41 and fst.held < 2000 + 40 * 400


def _splits(text):
    if not text:
        yield []
    for n in range(1, len(text) + 1):
        for rest in _splits(text[n:]):
            yield [text[:n], *rest]


# 1


def test_gated_lm(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(gated_lm, "COUNT_WORDS", 300)  # so that rarer words go the long way
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(True))
    df = docs
    v_args = gated_lm.vocabulary.__defaults__
    monkeypatch.setattr(gated_lm.vocabulary, "__defaults__", (300, 100, 8))
    found = gated_lm.score(df, held)
    got = sorted(((r._key, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found.collect()), key=str)
    monkeypatch.setattr(gated_lm.vocabulary, "__defaults__", v_args)
    tokens = [low(t or "").encode().split() + [0] for _, t in rows]
    out = [key is None or zlib.crc32(str(key).encode()) % 5 == 1 for key, _ in rows]
    c = collections.Counter(w for t, o in zip(tokens, out, strict=True) if not o for w in t)
    n, v = sum(c.values()), len(c)
    want = [(key, o, len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 6)) for (key, _), t, o in zip(rows, tokens, out, strict=True)]
    assert got == sorted(want, key=str)
    assert all(r.score < 0 and math.isfinite(r.score) for r in found.collect())
    assert gated_lm.score_digest(empty(docs)).count() == 0


def test_gated_lm_gradients():
    """Backpropagation against differences, and probabilities that add up to one."""
    v = gated_lm.Vocabulary(np.arange(9, dtype=np.uint64), np.arange(9, 0, -1), np.arange(9, dtype=np.int32), 45, 9, np.array([9.0, 8, 7, 6, 5, 4, 3, 2, 1]), np.array([0, 2, 5, 8, 9]), 0)
    rng = np.random.default_rng(0)
    model = gated_lm.Model(v, hidden=4)
    model.vector += rng.normal(0, 0.3, len(model.vector)).astype(np.float32)
    x, y = rng.integers(0, 9, (6, 3)), rng.integers(0, 9, (6, 3))
    keep = np.ones((6, 3), np.float32)
    keep[3, 1] = 0
    h = np.zeros((3, 4), np.float32)

    def loss(vector):
        m = gated_lm.Model(v, hidden=4).load(vector)
        states, _ = m.steps(x, keep, h)
        return -float(m.log_probs(states.reshape(-1, 4).astype(np.float64), y.ravel()).sum())

    grads = {}
    trainer = gated_lm.Trainer(model)

    def note(name, grad, rows=slice(None)):
        full = grads.setdefault(name, np.zeros(model.shapes[name]))
        full[rows] += grad

    trainer._step = note
    trainer.window(x, y, keep, np.ones((6, 3), bool), h)
    at = 0
    for name, shape in model.shapes.items():
        for j in rng.integers(0, math.prod(shape), 8).tolist():
            up, down = model.vector.copy(), model.vector.copy()
            up[at + j] += 1e-2
            down[at + j] -= 1e-2
            assert grads[name].reshape(-1)[j] == pytest.approx((loss(up) - loss(down)) / 2e-2, abs=3e-2, rel=3e-2), name
        at += math.prod(shape)
    states, _ = model.steps(x, keep, h)
    total = sum(np.exp(model.log_probs(states[0], np.full(3, s))) for s in range(9))
    assert total == pytest.approx(np.ones(3), abs=1e-4)


def test_gated_lm_learns():
    v = gated_lm.Vocabulary(np.arange(6, dtype=np.uint64), np.full(6, 100), np.arange(6, dtype=np.int32), 600, 6, np.full(6, 100.0), np.array([0, 2, 4, 5, 6]), 0)
    text = np.tile([1, 2, 3, 4, 0], 40)
    trainer = gated_lm.Trainer(gated_lm.Model(v), rate=0.3)
    first = np.arange(0, len(text) + 1, 5)
    before = gated_lm.score_documents(trainer.model, text, first, 0).sum()
    for _ in range(30):
        gated_lm.train_documents(trainer, text, first, 0)
    assert gated_lm.score_documents(trainer.model, text, first, 0).sum() > before * 0.3


def test_gated_lm_places():
    order = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 200_000)
    for tokens in (0, 10, 1 << 20, 5 << 20, 10**9, 10**14):
        warm, shards = gated_lm.rounds_of(tokens)
        turn, shard = gated_lm.place_of(order, warm, shards)
        assert turn.min() >= 0 and turn.max() <= gated_lm.ROUNDS and shard.min() >= 0 and shard.max() < max(1, shards)
        assert abs((turn == 0).mean() - warm) < 0.01 and (shard[turn == 0] == 0).all()
        if 1 < shards < 100:
            assert all(abs(((turn == t) & (shard == x)).mean() * gated_lm.ROUNDS * shards / (1 - warm) - 1) < 0.2 for t in range(1, gated_lm.ROUNDS + 1) for x in range(shards))


def test_gated_lm_is_the_same_for_any_partitioning(spark, monkeypatch):
    """Warm start, several rounds and shards: the same scores (to rounding) from 1 and 32 partitions, better than the base."""
    for name, value in (("WARM_TOKENS", 3000), ("SHARD_TOKENS", 2500)):
        monkeypatch.setattr(gated_lm, name, value)
    rng = random.Random(23)
    after = {w: rng.sample(VOCABULARY, 3) for w in VOCABULARY}
    texts = []
    for _ in range(1200):
        w = [rng.choice(VOCABULARY)]
        while len(w) < 40:
            w.append(rng.choice(after[w[-1]]))
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)) + [(None, "no id"), (None, None)], "doc_id bigint, text string")
    assert gated_lm.rounds_of(sum(len(t.split()) + 1 for t in texts))[1] > 3
    one = {r.doc_id: r for r in gated_lm.score_digest(df.coalesce(1)).where("doc_id is not null").collect()}
    many = {r.doc_id: r for r in gated_lm.score_digest(df.repartition(32)).where("doc_id is not null").collect()}
    assert all(many[k].score == pytest.approx(r.score, rel=1e-4) for k, r in one.items())
    held = [r for r in one.values() if r.held_out]
    assert len(held) > 100 and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_gated_lm_score_of_whole_documents():
    """A document's score is the sum over its symbols, one step after the other, whatever shares its lanes or windows."""
    rng = np.random.default_rng(3)
    v = gated_lm.Vocabulary(np.arange(9, dtype=np.uint64), np.arange(9, 0, -1), np.arange(9, dtype=np.int32), 45, 9, np.array([9.0, 8, 7, 6, 5, 4, 3, 2, 1]), np.array([0, 2, 5, 8, 9]), 0)
    model = gated_lm.Model(v, hidden=5)
    model.vector += rng.normal(0, 0.4, len(model.vector)).astype(np.float32)
    docs = [np.append(rng.integers(1, 9, n), 0) for n in (0, 1, 31, 32, 33, 200, 5, 64)]
    found = gated_lm.score_documents(model, np.concatenate(docs), np.cumsum([0, *map(len, docs)]), 0)
    sigmoid = lambda a: 1 / (1 + np.exp(-a))
    for d, total in zip(docs, found.tolist(), strict=True):
        h, x, want, k = np.zeros(5), 0, 0.0, 5
        for y in d.tolist():
            e, u = model.enter[x] + model.gate, h @ model.recur
            z, r = sigmoid(e[:k] + u[:k]), sigmoid(e[k : 2 * k] + u[k : 2 * k])
            new = np.tanh(e[2 * k :] + r * u[2 * k :])
            h = new + z * (h - new)
            c = int(model.class_of[y])
            logits = h @ model.cls + model.cls_bias
            a, b = int(v.classes[c]), int(v.classes[c + 1])
            own = model.word[a:b] @ h + model.word_bias[a:b]
            want += logits[c] - np.log(np.exp(logits).sum()) + own[y - a] - np.log(np.exp(own).sum())
            x = y
        assert total == pytest.approx(want, rel=1e-4)

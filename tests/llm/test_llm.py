"""Every operator against brute force, a library or a round trip, and on odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import textwrap
import time
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tandem.llm import bpe, chat, exact, labelled, licences, pages, quality, repeats, simhash, suffixes, tiling, toxicity
from tandem.llm.queries import QUERIES, tokenizer_file

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = "the of and ing er on re th wh sh at en".split()


def prose(rnd: random.Random, words: int) -> str:
    return " ".join("".join(rnd.choice(SYLLABLES) for _ in range(rnd.randint(1, 3))) for _ in range(words))


@pytest.fixture(scope="module")
def rows():
    """Copies, near copies, white space, repeats, nulls and long texts."""
    rnd = random.Random(7)
    base = [prose(rnd, rnd.randint(3, 400)) for _ in range(40)]
    texts = base + [base[0]] * 5 + [re.sub(" ", "\t\n", base[1]), base[2] + "\r\n", base[2].upper()]
    for t in base[3:15]:
        words = t.split(" ")
        words[rnd.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    shared = prose(rnd, 60)
    texts += [prose(rnd, 20) + " " + shared + " " + prose(rnd, 20) for _ in range(25)]
    texts += ["", None, " ", "\n\n", "a", "a b", "ab" * 700, "é" * 300, "x" * 5000, "Ünï " * 200, prose(rnd, 6000)]
    out = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return out + [out[0], (None, base[4], None, None, None), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With columns whose names the operators use inside."""
    return (
        spark.createDataFrame(rows, DOCS).repartition(4)
        .withColumn("digest", F.lit("x")).withColumn("fp", F.lit(1)).withColumn("packed", F.lit("p")).withColumn("row", F.lit(2))
        .withColumn("ids", F.lit("i")).withColumn("score", F.lit("s")).withColumn("text_hash", F.lit("h")).withColumn("bucket", F.lit(0))
    )


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def body(t):
    return t or ""


# 1 repeated strings


def brute_repeats(texts, window):
    raw = [body(t).encode() for t in texts]
    seen = Counter(t[p : p + window] for t in raw for p in range(len(t) - window + 1))
    for t in raw:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - window + 1):
            if seen[t[p : p + window]] > 1:
                gone[p : p + window] = True
        flips = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes() if t else b""
        yield len(t), [(a, b - a) for a, b in zip(flips[::2].tolist(), flips[1::2].tolist())], kept


def test_repeats(spark, docs, rows, nothing):
    want = sorted((k if k is not None else -1, *r) for (k, *_), r in zip(rows, brute_repeats([r[1] for r in rows], 200)))
    got = sorted(
        (r.doc_id if r.doc_id is not None else -1, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept))
        for r in repeats.repeats(docs).collect()
    )
    assert got == want
    assert repeats.repeats(nothing).count() == 0


def test_repeats_with_a_hot_passage(spark):
    """More different segments of one anchor than a suffix array takes go by window digests."""
    rnd = random.Random(5)
    passage = prose(rnd, 60)[:320]
    texts = [prose(rnd, 15) + passage + prose(rnd, 15) for _ in range(60)]
    got = repeats.repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    want = list(brute_repeats(texts, 200))
    assert all((r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) == want[r.doc_id] for r in got)


def test_copies_give_their_segments_once(spark, monkeypatch):
    rnd = random.Random(3)
    text = prose(rnd, 150)
    near = text[:600] + "changed" + text[607:]
    rows = list(enumerate([text] * 60 + [near]))
    held = []

    def kept(df, settle=repeats.settle):
        out = settle(df)
        if out.columns == ["anchor", "s1", "again", "content"]:
            held.append((out.count(), out.select("anchor", "s1").distinct().count()))
        return out

    monkeypatch.setattr(repeats, "settle", kept)
    got = repeats.repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    want = list(brute_repeats([t for _, t in rows], 200))
    assert len(got) == len(rows)
    assert all((r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) == want[r.doc_id] for r in got)
    assert len(held) == 1 and held[0][0] == held[0][1] > 0


@pytest.mark.parametrize("letters", [1, 2, 3, 25])
def test_suffix_arrays(letters):
    rnd = random.Random(letters)
    texts = [bytes(rnd.randint(1, letters) for _ in range(rnd.randint(0, 70))) + b"\0" for _ in range(200)]
    size = np.array([len(t) for t in texts])
    order = suffixes.suffix_arrays(np.frombuffer(b"".join(texts), np.uint8), size)
    for t, a in zip(texts, (np.cumsum(size) - size).tolist()):
        assert (order[a : a + len(t)] - a).tolist() == sorted(range(len(t)), key=lambda i: t[i:])


# 2 tokens


def test_tokens_match_the_library(spark, docs, rows, nothing):
    from tokenizers import Tokenizer

    rnd = random.Random(3)
    odd = "abc 'sll\n\t  \x1c\x85　éñ日本12٣!?🙂​_-I'LL\r\x0b"
    texts = [r[1] for r in rows] + ["".join(rnd.choice(odd) for _ in range(40)) for _ in range(300)]
    texts += ["a<|endoftext|>b  <|endoftext|>", "<|endoftext|>"]
    lib = Tokenizer.from_file(tokenizer_file())
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = bpe.decode(bpe.encode(frame, tokenizer_file()), tokenizer_file()).collect()
    assert sorted(got) == sorted(bpe.round_trip(frame, tokenizer_file()).collect())
    want = lib.encode_batch([body(t) for t in texts], add_special_tokens=False)
    for r in got:
        assert r.ids == want[r.doc_id].ids and r.decoded == body(texts[r.doc_id])
        assert r.decoded == lib.decode(r.ids, skip_special_tokens=False)
    assert bpe.digests(nothing, tokenizer_file()).count() == 0
    assert bpe.encode(docs, tokenizer_file()).columns == [c for c in docs.columns if c != "ids"] + ["ids"]
    null = spark.sql("select 1L as doc_id, cast(null as array<int>) as ids")
    assert bpe.decode(null, tokenizer_file()).first().decoded == ""


# 3 decontamination


def brute_tiles(a, b, least):
    """Greedy string tiling by its definition: the longest unmarked common run, again and again."""
    fa, fb, covered = [True] * len(a), [True] * len(b), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and fa[i + n] and fb[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return covered
        covered += n
        fa[i : i + n] = [False] * n
        fb[j : j + n] = [False] * n


def test_tiles():
    rnd = random.Random(2)
    for _ in range(60):
        a = [rnd.randint(0, 4) for _ in range(rnd.randint(1, 25))]
        b = [rnd.randint(0, 4) for _ in range(rnd.randint(0, 40))]
        for _ in range(rnd.randint(0, 2)):
            s = rnd.randrange(len(a))
            b[rnd.randint(0, len(b)) : 0] = a[s : s + 9]
        found = tiling.tiles(np.array(a, np.uint64), np.array(b, np.uint64), 3)
        assert all(a[i : i + n] == b[j : j + n] and n >= min(3, len(a)) for i, j, n in found)
        for side, size in ((0, len(a)), (1, len(b))):
            used = [p for t in found for p in range(t[side], t[side] + t[2])]
            assert len(used) == len(set(used)) and all(p < size for p in used)
        # Ties may be broken otherwise, which moves the total by less than a tile.
        assert abs(sum(n for _, _, n in found) - brute_tiles(a, b, min(3, len(a)))) <= 3


def test_decontamination(spark, docs, nothing):
    rnd = random.Random(11)
    items = [prose(rnd, 40), prose(rnd, 3), "", None, prose(rnd, 50)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    w = items[0].split()
    moved = " ".join(w[20:] + ["x"] + w[:20]).upper().replace(" ", ", ")
    half = " ".join(w[:20])
    new = [
        (1000, prose(rnd, 30) + " " + items[0] + " " + prose(rnd, 9)), (1001, moved), (1002, half), (1003, "a " + items[1] + " b"),
        (None, items[4]), (1005, items[4]), (1005, items[4]),
    ]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(new, "doc_id long, text string")).withColumn("seeds", F.lit(1))
    got = Counter((r.doc_id, r.item_id) for r in tiling.contaminated(both, bench).collect())
    assert got == {(1000, 0): 1, (1001, 0): 1, (1003, 1): 1, (None, 4): 1, (1005, 4): 2}
    assert [r.coverage for r in tiling.overlaps(both, bench).where("doc_id = 1002").collect()] == [0.5]
    left = tiling.clean(both, bench)
    assert left.columns == both.columns and left.count() == both.count() - 6
    assert tiling.clean(nothing, bench).count() == 0
    assert tiling.clean(docs, bench.limit(0)).count() == docs.count()


def test_pairs_that_cannot_be_covered_are_not_tiled(spark, monkeypatch):
    """One phrase in every item and document: only pairs with enough words under shared seeds are tiled, the result is the same."""
    rnd = random.Random(17)
    phrase = prose(rnd, 6)
    items = [prose(rnd, 12) + " " + phrase + " " + prose(rnd, 12) for _ in range(30)]
    items += ["a b c d a b c d a b c d", prose(rnd, 4)]
    texts = [prose(rnd, 20) + " " + phrase + " " + prose(rnd, 20) for _ in range(40)]
    texts += [f"x {items[3]} y", " ".join(items[7].split()[:25]), "q " + items[30] + " d", items[31], " ".join(items[5].split()[15:] + items[5].split()[:15])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    every = tiling.overlaps(docs, bench).collect()
    assert len(every) >= 30 * 40
    able = tiling.overlaps(docs, bench, least=0.8).collect()
    assert len(able) < 20
    want = {(r.doc_id, r.item_id, r.coverage) for r in every if r.coverage >= 0.8}
    assert {(r.doc_id, r.item_id, r.coverage) for r in able if r.coverage >= 0.8} == want and len(want) >= 5
    assert {(r.doc_id, r.item_id, r.coverage) for r in tiling.contaminated(docs, bench).collect()} == want


# 4 near-dedup


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), body(text)))
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    root = {f: f for f in fps}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= 3:
                root[top(a)] = top(b)
    return {f: top(f) for f in fps}


def test_near_dedup(spark, docs, rows, nothing):
    fps = [plain_fingerprint(r[1]) for r in rows]
    comp = brute_components(set(fps))
    low: dict[int, int] = {}
    for (k, *_), f in zip(rows, fps):
        if k is not None:
            low[comp[f]] = min(low.get(comp[f], k), k)
    want = Counter((r[0], f"{f:016x}", low[comp[f]]) for r, f in zip(rows, fps))
    assert Counter(tuple(r) for r in simhash.groups(docs).collect()) == want
    first = simhash.first_of_each(docs)
    assert first.columns == docs.columns
    assert sorted(r.doc_id for r in first.collect()) == sorted(set(low.values()))
    assert simhash.groups(nothing).count() == simhash.first_of_each(nothing).count() == 0


@pytest.mark.parametrize("leaf", [200, 4])
def test_shards_lose_no_link(spark, monkeypatch, leaf):
    """The tree is as deep as the number of fingerprints asks for: no link is lost at any depth."""
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 1500, dtype=np.int64)
    fps = [base]
    for bits in (1, 2, 3):
        near = base[:700].view(np.uint64).copy()
        for _ in range(bits):
            near ^= np.uint64(1) << rng.integers(0, 64, 700, dtype=np.uint64)
        fps.append(near.view(np.int64))
    ball = base[0].view(np.uint64) ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))
    fps = np.unique(np.concatenate([*fps, ball.view(np.int64)]))
    monkeypatch.setattr(simhash, "LEAF", leaf)
    monkeypatch.setattr(simhash, "BLOCK", 300)
    frame = spark.createDataFrame([(int(x),) for x in fps], "fp long")
    got = {r.node: r.root for r in simhash.components(simhash.links(frame)).collect()}
    u = fps.view(np.uint64)
    near = np.bitwise_count(u[:, None] ^ u[None, :]) <= 3
    label = np.arange(len(fps))
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            break
        label = new
    assert {int(f): int(fps[m]) for f, m in zip(fps, label) if fps[m] != f} == got


# 5 exact dedup


def test_exact_dedup(spark, docs, rows, nothing):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", body(r[1])) for r in rows]
    keys: dict[str, list] = {}
    for (k, *_), t in zip(rows, norm):
        keys.setdefault(t, []).append(k)
    want = Counter()
    for (k, *_), t in zip(rows, norm):
        keep = min(x for x in keys[t] if x is not None)
        want[k, keep, len(keys[t]), k == keep, hashlib.sha256(t.encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in exact.groups(docs).collect()) == want
    first = exact.first_of_each(docs)
    assert first.columns == docs.columns and first.count() == len(keys)
    assert exact.groups(nothing).count() == exact.first_of_each(nothing).count() == 0
    alone = spark.createDataFrame([(None, "q"), (None, "q ")], "doc_id long, text string")
    assert [(r.keep_id, r.kept) for r in exact.groups(alone).collect()] == [(None, True)] * 2
    with pytest.raises(Exception, match="share a digest"):  # a digest alone never decides
        _collide(docs).collect()


def _collide(d):
    """``groups`` with a digest that is the same for all texts."""
    real = exact.F.sha2
    exact.F.sha2 = lambda c, b: F.lit("same")
    try:
        return exact.groups(d)
    finally:
        exact.F.sha2 = real


# 6 chat


def test_chat_trees(spark):
    nodes = [
        ("t", 1, None, "user", "root <|turn|> \\l", 0.5), ("t", 2, 1, "assistant", "good <|end|>", 0.9), ("t", 3, 1, "assistant", "bad", 0.1),
        ("t", 4, 2, "user", None, 0.0), ("u", 1, 99, None, "alone\n", None), (None, 1, None, "assistant", "", 0.0),
    ]
    schema = "tree string, node long, parent long, role string, text string, score double"
    frame = spark.createDataFrame(nodes, schema).withColumn("leaf", F.lit("clash"))
    made = chat.conversations(frame)
    got = {(r.tree, r.leaf): r for r in made.withColumn("turns", chat.parsed(F.col("formatted"))).withColumn(
        "learned", chat.learned(F.col("formatted"), F.col("loss"))).collect()}
    assert set(got) == {("t", 4), ("t", 3), ("u", 1), (None, 1)}
    assert [tuple(x) for x in got["t", 4].turns] == [("user", "root <|turn|> \\l"), ("assistant", "good <|end|>"), ("user", "")]
    assert got["t", 4].learned == "good <|end|>" and got["u", 1].learned == ""
    assert (got["t", 4].rank, got["t", 3].rank) == (1, 2)
    long = spark.range(1, 301).select(
        F.lit("c").alias("tree"), F.col("id").alias("node"), (F.col("id") - 1).alias("parent"), F.lit("user").alias("role"),
        F.col("id").cast("string").alias("text"), F.lit(0.0).alias("score"),
    )
    one = chat.conversations(long).withColumn("turns", chat.parsed(F.col("formatted"))).collect()
    assert len(one) == 1 and [t.text for t in one[0].turns] == [str(i) for i in range(1, 301)]
    loop = spark.createDataFrame([("t", 1, 2, "u", "", 0.0), ("t", 2, 1, "u", "", 0.0), ("t", 3, 2, "u", "", 0.0)], schema)
    with pytest.raises(Exception, match="cycle"):
        chat.conversations(loop).collect()
    assert chat.conversations(frame.limit(0)).count() == 0


# 7 pages


def test_blocks():
    page = (
        "<html><head><title>x</title><script>var a='</p>';</script></head><body><header>Site</header><nav><ul><li>a<li>b</ul></nav>"
        '<div class="cookie-notice">We use <b>cookies</b></div><article><h1>T &amp; t</h1><p>One<b>two</b>&nbsp; three<p>four<br>five'
        "<aside>no</aside><form>q<input></form><table><tr><td>c1<td>c2</table><div class=ad>buy</div><!-- c --></article>"
        '<section id="comments"><p>nice</section><footer>f</footer>'
    )
    assert [t for z, t in pages.blocks(page) if z == pages.MAIN] == ["T & t", "Onetwo three", "four", "five", "c1", "c2"]
    assert pages.blocks("") == [] and pages.blocks("1 < 2 &lt;b&gt;") == [(0, "1 < 2 <b>")]


class Plain(HTMLParser):
    """Article text of well-formed pages, the plain way: a stack, and every element asked whether it is frame."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.parts = [], [[]]

    def handle_starttag(self, tag, attrs):
        if tag in ("br", "hr", "img"):
            if tag != "img":
                self.parts.append([])
            return
        names = dict(attrs).get("class", "").split()
        frame = tag in ("nav", "aside", "footer", "header", "form", "script", "style") or "ad" in names or "comments" in names
        self.stack.append((tag, frame))
        if tag not in pages.INLINE or frame:
            self.parts.append([])

    def handle_endtag(self, tag):
        name, frame = self.stack.pop()
        assert name == tag
        if tag not in pages.INLINE or frame:
            self.parts.append([])

    def handle_data(self, data):
        if any(t == "article" for t, _ in self.stack) and not any(f for _, f in self.stack):
            self.parts[-1].append(data)

    def text(self):
        return " ".join(t for p in self.parts if (t := " ".join("".join(p).split())))


def test_pages_against_a_plain_extractor(spark):
    rnd = random.Random(23)

    phrase = ["span", "b", "inline ad", "text", "text", "text", "br"]

    def element(depth, inside=()):
        kind = rnd.choice(phrase + ([] if inside == "phrase" else ["p", "div", "section", "ul", "nav", "aside", "ad", "comments"]))
        if kind == "text" or depth > 5:
            return rnd.choice(["word ", "a &amp; b ", " two  three\n", "x", "5 < 6 ", "&nbsp;", ""])
        if kind == "br":
            return "<br>"
        inside = "phrase" if kind in (*phrase, "p") else inside
        inner = "".join(element(depth + 1, inside) for _ in range(rnd.randint(0, 4)))
        tag, own = {"ad": ("div", ' class="ad x"'), "inline ad": ("span", " class='ad'"), "comments": ("div", ' class="comments"')}.get(kind, (kind, ""))
        return f"<{tag}{own}>{inner}</{tag}>"

    made = [f"<nav>menu</nav><article>{''.join(element(0) for _ in range(8))}</article><footer>f</footer>" for _ in range(300)]
    made += [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").where("html like '%<ul><li><a%</a></li>%' and html not like '%<b>%'").collect()]
    checked = 0
    for page in made:
        plain = Plain()
        try:
            plain.feed(page)
        except (AssertionError, IndexError):
            continue  # not well formed
        checked += 1
        assert " ".join(t for z, t in pages.blocks(page) if z == pages.MAIN) == plain.text(), page
    assert checked >= 250


def test_frames_inside_the_article(spark):
    leak = '<article><p>A <span class="ad"><span>buy</span> LEAK</span> B</p></article>'
    assert [t for _, t in pages.blocks(leak)] == ["A", "B"]
    page = (
        '<article><h1>{0}</h1><div class="share-price">12 {0}</div><section id="related-work">prior {0}</section><p class="alert">warning {0}</p>'
        '<h2 class="tags">Tags {0}</h2><div class="share-box">Tell your friends</div><div class="share">gone</div><p>Tell your friends</p>{1}</article>'
    )
    rows = [(i, f"http://h/{i}", page.format(w, f"long text of {w} " * 9)) for i, w in enumerate(("one", "two", "three"))]
    rows.append((9, "http://alone/1", page.format("four", "")))
    got = {r.page_id: r.text for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, w in enumerate(("one", "two", "three")):
        head = f"{w} 12 {w} prior {w} warning {w} Tags {w}"
        assert got[i] == f"{head} Tell your friends " + f"long text of {w} " * 8 + f"long text of {w}"
    assert got[9] == "four 12 four prior four warning four Tags four Tell your friends Tell your friends"


def test_long_pages_take_linear_time():
    for page in ('<p a="' * 170_000, "<p <p " * 160_000, "<p a=\"<p b='" * 80_000, "</x>" * 250_000, "<div>" * 90_000 + "</p>" * 90_000,
                 "<!" * 400_000, "<script " * 120_000, "<a " * 300_000 + ">"):
        start = time.perf_counter()
        pages.blocks(page)
        assert time.perf_counter() - start < 10
    lines = np.random.default_rng(0).integers(0, 10**6, 20_000)
    other = np.concatenate([lines[:9000], lines[11_000:]])
    start = time.perf_counter()
    assert pages.common(lines, other).sum() == 18_000
    assert time.perf_counter() - start < 5


def test_common_lines():
    rnd = random.Random(4)
    for k in range(200):
        a, b = ([rnd.randint(0, 5 if k % 2 else 40) for _ in range(rnd.randint(0, 15 if k % 2 else 60))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        kept = [x for x, k in zip(a, pages.common(np.array(a, np.int64), np.array(b, np.int64))) if k]
        assert len(kept) == table[-1][-1]
        it = iter(b)
        assert all(x in it for x in kept)


def test_pages(spark):
    frame = "<div>Menu of the site</div><p>{}</p><div>All about us and our partners</div>"
    data = [
        (1, "http://h/a/1", frame.format("first story " * 9)), (2, "http://h/a/2?x=1", frame.format("second story " * 9)),
        (3, "http://other/a/1", frame.format("third story " * 9)), (4, None, None), (5, "http://h/z", ""), (5, "http://h/z", ""),
        (6, "http://h/a/3", "<nav>n</nav><article><p>Menu of the site</p>kept</article>"), (None, "http://h/a/9", "<p>x"),
        (7, "http://m/a", frame.format("copy " * 30)), (8, "http://m/b", frame.format("copy " * 30)),
    ]
    got = pages.main_text(spark.createDataFrame(data, "page_id long, url string, html string").repartition(3).withColumn("row", F.lit(1)))
    text = {}
    for r in got.collect():
        text.setdefault(r.page_id, []).append(r.text)
        assert r.n_chars == len(r.text)
    menu, about = "Menu of the site ", " All about us and our partners"
    assert text[1] == [("first story " * 9).strip()] and text[2] == [("second story " * 9).strip()]
    assert text[3] == [menu + ("third story " * 9).strip() + about]
    assert text[4] == [""] and text[5] == ["", ""] and text[6] == ["Menu of the site kept"] and text[None] == ["x"]
    assert text[7] == text[8] == [menu + ("copy " * 30).strip() + about]  # copies are not each other's frame
    assert pages.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# 8 licences


def test_licences(spark, nothing):
    mit = licences.KNOWN[0][1]
    data = [
        (1, "Copyright (c) 1999 A. Nobody\n\n" + mit.upper().replace("\n", "\n  * ")), (2, "x\n" + "This project is LICENCED under it\nReleased under the MIT Licence!"),
        (3, None), (4, mit + " and more"), (None, "Licensed under CC BY-NC 4.0."), (5, "released under the mit license\nReleased under the MIT License."), (5, ""),
    ]
    got = {}
    for r in licences.scan(spark.createDataFrame(data, "doc_id long, text string").withColumn("digest", F.lit(1))).collect():
        got.setdefault(r.doc_id, []).append((r.whole_licence, r.notices, r.n_notices))
    assert got[1] == [("MIT", "", 0)] and got[2] == [(None, "MIT", 1)] and got[3] == [(None, "", 0)] and got[4] == [(None, "", 0)]
    assert got[None] == [("CC-BY-NC-4.0", "CC-BY-NC-4.0", 1)] and sorted(got[5], key=str) == [(None, "", 0), (None, "MIT", 2)]
    assert licences.scan(nothing).count() == 0


def test_licences_in_any_wrap(spark):
    full = {}
    for name, text in licences.wordings():
        if len(text) > 300:
            full.setdefault(name, text)
    assert len(full) == 14
    data, want = [], {}

    def add(name, text):
        want[len(data)] = name
        data.append((len(data), text))

    titles = {"MIT": "The MIT License (MIT)", "ISC": "ISC License", "BSD-3-Clause": "BSD 3-Clause License", "BSD-2-Clause": "BSD 2-Clause License"}
    for name, text in full.items():
        paragraphs = [" ".join(p.split()) for p in re.split(r"\n\s*\n", text)]
        add(name, text)
        add(name, text.replace("\n", "\r\n"))
        for width in (40, 60, 72, 76, 78, 80, 10**6):
            body = "\n\n".join("\n".join(textwrap.wrap(p, width)) for p in paragraphs)
            add(name, body)
            if name in titles or name in ("0BSD", "Zlib", "Unlicense"):
                add(name, f"{titles.get(name, 'License')}\n\nCopyright (c) 2011-2020, A. Nobody <a@b.c>\nAll rights reserved.\n\n" + body)
                add(name, f"{titles.get(name, 'License')}\nCopyright Jane Doe\n\n" + body)
                add(name, f"Copyright © 2019 The Software Foundation\n(c) 2020 B. Nobody\n\n{titles.get(name, 'License')}\n\n" + body)
                add(name, " ".join(f"Copyright (c) 2020 Jane Doe {body}".split()))
    bsd = full["BSD-3-Clause"].replace("the copyright holder nor", "Example Corp. nor").replace("THE COPYRIGHT HOLDERS AND", "EXAMPLE AND")
    add("BSD-3-Clause", re.sub(r"(?m)^[123]\.", "*", bsd))
    add(None, full["MIT"] + "\nand more")
    add(None, full["MIT"].replace("COPYRIGHT HOLDERS BE", "COPYRIGHT HOLDERS NOT BE"))
    add(None, "MIT License")
    got = {r.doc_id: r.whole_licence for r in licences.scan(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert [(i, data[i][1][:200]) for i in want if got[i] != want[i]] == []


# 9, 10 classifiers


def held_out(spark, judge, label, sf="/root/testdata/sf0.01"):
    read = lambda n: spark.read.parquet(f"{sf}/{n}.parquet")
    got = judge(read("documents").withColumn("score", F.lit("clash")), read("labels"))
    return got, got.join(read("labels"), "doc_id").where("held_out").toPandas()


def test_quality(spark, nothing, docs):
    got, j = held_out(spark, quality.judged, "quality")
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and (j.score.between(0, 1)).all()
    assert (j.predicted == j.quality).mean() > 0.97
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 1), (None, 1, 1), (2, None, None), (0, 0, 0)], "doc_id long, quality int, toxic int")
    out = quality.judged(docs, labels).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    assert quality.judged(docs, labels.limit(0)).where("score = 0.5").count() == docs.count()
    assert quality.judged(nothing, labels).count() == 0
    assert quality.accepted(docs, labels.limit(0)).columns == docs.columns


def test_votes_are_exact():
    rng = np.random.default_rng(1)
    m = quality.Model(np.array([0, 1]), np.array([0, 1]), np.array([1.0, 1.0]), np.array([0, 1]), np.ones(8, np.float32))
    m.vectors, m.labels = rng.normal(size=(60, 32)).astype(np.float32), rng.integers(0, 2, 60).astype(np.float32)
    x = rng.normal(size=(40, 32)).astype(np.float32)
    cos = x @ m.vectors.T
    for row, got in zip(cos, m.votes(x)):
        near = np.argsort(-row)[: quality.NEIGHBOURS]
        w = np.maximum(row[near], 0) ** 4
        assert got == pytest.approx((w * m.labels[near]).sum() / w.sum(), abs=1e-5)


def brute_segments(x):
    """Maximal scoring subsequences by their definition: split at the best one, recursively."""
    best, span = 0.0, None
    for i in range(len(x)):
        for j in range(i + 1, len(x) + 1):
            if (s := sum(x[i:j])) > best + 1e-9:
                best, span = s, (i, j)
    if span is None:
        return []
    a, b = span
    left, right = brute_segments(x[:a]), brute_segments(x[b:])
    return [*left, (a, b), *((p + b, q + b) for p, q in right)]


def test_segments():
    rng = np.random.default_rng(2)
    for _ in range(150):
        x = rng.normal(-0.2, 1, rng.integers(0, 25))
        assert [(a, b) for _, a, b in toxicity.segments(x)] == brute_segments(x.tolist())


def test_toxicity(spark, nothing, docs):
    got, j = held_out(spark, toxicity.judged, "toxic")
    assert (j.score.between(0, 1)).all() and got.count() == 1000
    assert j[j.toxic == 0].predicted.mean() < 0.05 and (j.predicted == j.toxic).mean() > 0.9
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.judged(docs, labels).count() == docs.count()
    assert toxicity.judged(docs, labels.limit(0)).where("predicted = 0").count() == docs.count()
    assert toxicity.judged(nothing, labels).count() == 0


def test_samples_are_bounded(spark):
    labels = spark.range(1000).select(F.col("id").alias("doc_id"), (F.col("id") % 4 == 0).cast("int").alias("toxic"))
    keys, values = labelled.sample(labels, "toxic", "doc_id", F.lit(True), 50)
    assert len(keys) == 100 and values.sum() == 50 and (np.diff(keys) > 0).all()


# the pipeline


def test_pipeline(spark):
    """The rows of ``run`` against the same decisions made one by one."""
    import pandas as pd

    docs = pd.read_parquet(f"{SF}/documents.parquet")
    scores = {r.doc_id: r.score for r in QUERIES["op9_quality_score"](spark, SF).collect()}
    left = [(i, t) for i, t in zip(docs.doc_id, docs.text) if scores[i] >= 0.3]
    first: dict[str, int] = {}
    for i, t in sorted(left):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", body(t)), i)
    left = [(i, t) for i, t in left if i in set(first.values())]
    fps = {i: plain_fingerprint(t) for i, t in left}
    comp = brute_components(set(fps.values()))
    low: dict[int, int] = {}
    for i, f in fps.items():
        low[comp[f]] = min(low.get(comp[f], i), i)
    left = [(i, t) for i, t in left if i in set(low.values())]
    split = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", body(t).lower())
    items = [" ".join(split(t)) for t in pd.read_parquet(f"{SF}/benchmark.parquet").text]
    whole = {i for i, t in left if any(f" {x} " in f" {' '.join(split(t))} " for x in items)}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in got} == {i for i, _ in left} - whole and all(r.round_trip for r in got)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_filter", "exact_dedup", "near_dedup", "decontaminate", "tokenize"]


def test_stages_keep_columns_and_take_odd_rows(spark, rows, nothing):
    docs = spark.createDataFrame(rows, DOCS)
    for given in (docs, nothing):
        kept = given
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, kept, SF)
            assert kept.columns == docs.columns
        assert corpus_pipeline.STAGES[-1][1](spark, kept, SF).where("not round_trip").count() == 0


def test_stages_are_written_and_ties_have_one_winner(spark, monkeypatch):
    runs = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            runs.add(b.num_rows)
            yield b

    stages = [
        ("count", lambda s, d, f: d.select("doc_id").mapInArrow(counted, "doc_id long")),
        ("twice", lambda s, d, f: d.unionByName(d.withColumn("doc_id", -F.col("doc_id")))),
    ]
    monkeypatch.setattr(corpus_pipeline, "STAGES", stages)
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert corpus_pipeline.run(spark, SF).count() == 2 * n and runs.value == n
    rows = [(1, "a b"), (1, "a  b"), (1, "a\tb"), (None, "c d"), (None, "c\nd")]
    won = [
        {r.text for r in exact.first_of_each(spark.createDataFrame(given, "doc_id long, text string").coalesce(1)).collect()}
        for given in (rows, rows[::-1], rows[1:] + rows[:1])
    ]
    assert won[0] == won[1] == won[2] and len(won[0]) == 2

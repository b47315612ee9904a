"""Operators against plain Python on rows with every odd case, and on empty tables."""

import zlib
from collections import Counter
from html import unescape
from html.parser import HTMLParser

import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from coursegrid.llm import (
    cross_entropy, near_dup, packing, perspective, quality_rules, secret_ledger, substring, toxicity, warc, winnowing,
)

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def same(got, want):
    assert Counter(got) == Counter(want)


def test_quality(documents, rows):
    got = quality_rules.assess(documents).collect()
    same(
        [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got],
        [(i, *brute.quality(t)) for i, t in rows],
    )
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_secrets(documents, rows):
    ledger = secret_ledger.scan(documents)
    found = secret_ledger.findings(documents, ledger, path_col="doc_id")
    base = F.filter("spans", lambda s: s["rank"] < 3)
    got = found.select("path", secret_ledger.joined(base).alias("spans")).collect()
    same([(r.path, r.spans) for r in got], [(i, ",".join(brute.secrets(t))) for i, t in rows])
    assert any(len(brute.secrets(t)) >= 3 for _, t in rows)


def test_ledger_scans_only_what_is_new(spark, documents):
    first = secret_ledger.scan(documents).cache()
    assert secret_ledger.scan(documents, first).isEmpty()
    newer = [r._replace(version=2) if r.kind == "hex" else r for r in secret_ledger.RULES]
    again = secret_ledger.scan(documents, first, newer).collect()
    assert {tuple(r.scanned) for r in again} == {("hex:2",)} and len(again) == first.count()
    more = documents.unionByName(documents.limit(1).withColumn("text", F.lit("token = 0123456789")), allowMissingColumns=True)
    fresh = secret_ledger.scan(more, first)
    assert [[s.kind for s in r.spans] for r in fresh.collect()] == [["assign"]]
    both = secret_ledger.findings(more, first.unionByName(fresh), path_col="doc_id")
    assert both.count() == more.count()
    # an old version of a path keeps its findings, and a changed rule's old findings do not show
    changed = secret_ledger.findings(documents, first.unionByName(secret_ledger.scan(documents, first, newer)), newer, "doc_id")
    assert {s.version for r in changed.collect() for s in r.spans if s.kind == "hex"} == {2}


def test_redaction(documents, rows):
    got = secret_ledger.redact(documents)
    assert got.columns == documents.columns
    texts = {r.doc_id: r.text for r in got.collect() if r.doc_id}
    assert texts[13] == "<secret>, API_KEY: 'abc', <secret>:abcdef12 <secret> <secret>"
    same([texts[i] for i in (1, 5, 12)], [dict(rows)[i] for i in (1, 5, 12)])
    assert got.count() == len(rows)


def test_overlapping_spans(spark):
    text = "secret=" + "0123456789abcdef" * 2 + "! end"
    got = secret_ledger.redact(spark.createDataFrame([(text,)], "text string")).first().text
    assert got == "<secret>! end"


def test_winnowing(spark, documents, rows):
    passage = rows[0][1].split()
    items = [
        (1, " ".join(passage[5:30])), (2, " ".join(passage[10:20]).upper()), (3, " ".join(passage[20:29])), (4, "one"),
        (5, None), (6, "..."), (None, " ".join(passage[40:52])), (2, " ".join(passage[10:20]).upper()),
        (7, " ".join(passage[:9]) + " unknown " + " ".join(passage[9:18])), (8, " ".join(passage[50:55])),
    ]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = winnowing.hits(documents, benchmark).collect()
    unique = list(dict.fromkeys((i, t or "") for i, t in rows))
    want = [(i, *x) for (i, _), x in zip(unique, brute.hits([t for _, t in unique], items))]
    same([(r.doc_id, r.n_words, r.n_hit, ",".join(r["items"])) for r in got], [(i, n, h, ",".join(m)) for i, n, h, m in want])
    assert all(r.contaminated == (r.n_hit > 0) for r in got)
    kept = winnowing.clean(documents, benchmark)
    assert kept.columns == documents.columns
    bad = {(i, t) for (i, t), x in zip(unique, want) if x[2]}
    same([(r.doc_id, r.text) for r in kept.collect()], [(i, t) for i, t in rows if (i, t or "") not in bad])


@pytest.mark.parametrize("span", [3, 5, 8])
def test_winnowing_finds_every_shared_span(spark, rows, span):
    items = [(k, " ".join(t.split()[k : k + span + k % 4])) for k, (_, t) in enumerate(rows) if t and len(t.split()) > 40]
    texts = [(i, t) for i, t in rows if i is not None and i != 12]
    got = winnowing.hits(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), span)
    want = brute.hits([t for _, t in texts], items, span)
    same([(r.doc_id, r.n_hit, ",".join(r["items"])) for r in got.collect()], [(i, h, ",".join(m)) for (i, _), (_, h, m) in zip(texts, want)])


@pytest.mark.parametrize("size,threshold", [(3, 85), (5, 80)])
def test_near_duplicates(documents, rows, size, threshold):
    got = near_dup.group(documents, size, threshold).collect()
    of = brute.components(rows, size, threshold)
    same(
        [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got],
        [(i, len(brute.shingles(t, size)), of.get(i), i is None or of[i] == i) for i, t in rows],
    )
    kept = near_dup.clean(documents, size, threshold)
    assert kept.columns == documents.columns
    same([r.doc_id for r in kept.collect()], [i for i, _ in rows if i is None or of[i] == i])


def test_ids_with_several_texts(spark):
    """An id is one document, linked through any of its texts; its rows lie in one component."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    texts = [(5, a), (5, b), (9, a), (3, b), (7, c), (9, c), (6, None), (6, c + " more"), (8, "")]
    got = near_dup.group(spark.createDataFrame(texts, "doc_id long, text string"), 3, 85).collect()
    want = brute.components(texts, 3, 85)
    assert want[9] == 3
    for r in got:
        assert r.component_id == (want[r.doc_id] if r.n_shingles else r.doc_id)


def test_chains_of_near_copies(spark):
    """A family in which most pairs are below the threshold and the components come from chains."""
    rng = np.random.default_rng(5)
    base, texts = [f"w{k}" for k in range(60)], []
    for family in range(4):
        words = [f"f{family}{w}" for w in base]
        for k in range(60):
            if rng.random() < 0.3:
                for at in rng.integers(0, 60, rng.integers(1, 4)):
                    words[at] = f"x{family}-{k}-{at}"
            texts.append((len(texts), " ".join(words)))
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dup.group(frame, 3, 85).collect()}
    assert got == brute.components(texts, 3, 85)
    assert 4 < len(set(got.values())) < 120


def test_signature_estimate():
    """Equal low bits, corrected for chance, estimate the similarity."""
    rng = np.random.default_rng(1)
    for share in (0.5, 0.85, 1.0):
        errors = []
        for _ in range(60):
            n, common = 400, int(round(400 * 2 * share / (1 + share)))
            pool = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
            pair = [np.sort(pool[:n]), np.sort(np.concatenate([pool[:common], pool[n : 2 * n - common]]))]
            low = near_dup._low_bits(near_dup._minima(pair))
            x = low[0] ^ low[1]
            other = sum(int(v).bit_count() for v in (x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555))
            errors.append((1 - other / near_dup.LANES - 0.25) / 0.75 - share)
        assert abs(np.mean(errors)) < 0.03 and np.max(np.abs(errors)) < near_dup.MARGIN


@pytest.mark.parametrize("window", [5, 35])
def test_substrings(documents, rows, window):
    got = substring.remove_repeats(documents, window).collect()
    want = brute.without_repeats([t for _, t in rows], window)
    same([(r.doc_id, r.n_words, r.n_removed, r.text) for r in got], [(i, *x) for (i, _), x in zip(rows, want)])
    assert all(sum(b - a for a, b in r.removed) == r.n_removed for r in got)


def test_packing(documents, rows):
    got = packing.pack(documents, TOKENIZER, window=64, keep_ids=True).collect()
    tokenizer, pieces = Tokenizer.from_file(TOKENIZER), {}
    want = Counter((i, (*tokenizer.encode(t or "", add_special_tokens=False).ids, 0)) for i, t in rows)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32
        pieces.setdefault(r.doc_id, Counter())[(r.start, tuple(ids.tolist()), r.doc_tokens)] += 1
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    for (i, ids), n in want.items():
        for low in range(0, len(ids), 64):
            assert pieces[i][(low, ids[low : low + 64], len(ids))] >= n
    assert sum(r.length for r in got) == sum(len(ids) * n for (_, ids), n in want.items())
    assert sum(r.length for r in got) > 0.97 * 64 * len(sequences)


def test_plan_holds_the_histogram():
    rng = np.random.default_rng(3)
    for n in (1, 7, 300, 20_000):
        histogram = Counter(int(x) for x in rng.integers(1, 129, n))
        plan = packing.packed(128, histogram)
        used = Counter()
        for pattern, times in plan:
            assert sum(pattern) <= 128 and times > 0
            for length in pattern:
                used[length] += times
        assert used == histogram
        if n >= 20_000:
            assert sum(k * v for k, v in histogram.items()) > 0.995 * 128 * sum(t for _, t in plan)


def test_least_squares_reaches_an_exact_solution():
    patterns = [(4,), (3, 1), (2, 2), (2, 1, 1)]
    histogram = {4: 5, 3: 7, 2: 9, 1: 13}  # 5, 7, 1.5, 6
    x = packing.least_squares(patterns, histogram, 2000)
    rest = {n: c - sum(v * p.count(n) for v, p in zip(x, patterns)) for n, c in histogram.items()}
    assert min(x) >= 0 and max(map(abs, rest.values())) < 0.05


def test_toxicity(spark, documents, rows):
    labelled = [(k, f"{'awful zyxword ' if k % 4 == 0 else ''}{rows[k % 4][1]} text {k}") for k in range(400)]
    texts = spark.createDataFrame(labelled, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k, _ in labelled] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(texts, labels)
    scored = toxicity.score(texts.withColumn("out", toxicity.held_out("doc_id")), model).collect()
    assert all((r.score >= 0.5) == (r.doc_id % 4 == 0) for r in scored if r.out)
    got = toxicity.score(documents, model, score_col="toxic_score")
    assert got.columns == [*documents.columns, "toxic_score"]
    got = got.collect()
    same([(r.doc_id, r.text) for r in got], rows)
    assert all(0 <= r.toxic_score <= 1 for r in got)
    kept = toxicity.clean(documents, labels, training=texts)
    assert kept.columns == documents.columns and kept.count() == sum(r.toxic_score < 0.5 for r in got)
    none = toxicity.train(texts, labels.filter("toxic = 0"))
    assert max(r.score for r in toxicity.score(texts, none).collect()) < 1e-6


def test_toxicity_by_how_often_a_part_comes(spark):
    """A part of a word that is once in each text of label 0 and often in those of label 1."""
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abdeghiklmnorstu"), 6))
    labels = [(k, int(k % 8 == 0)) for k in range(400)]
    said = [" ".join(rng.permutation([word() for _ in range(40)] + ["zyx" + word() for _ in range(5 if y else 1)])) for _, y in labels]
    texts = spark.createDataFrame([(k, t) for (k, _), t in zip(labels, said)], "doc_id long, text string")
    model = toxicity.train(texts, spark.createDataFrame(labels, "doc_id long, toxic int"))
    found = {r.doc_id: r.score >= 0.5 for r in toxicity.score(texts, model).collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    assert found == {k: bool(y) for k, y in labels if k in found} and any(found.values())


def test_regression_ends_at_its_minimum():
    rng = np.random.default_rng(6)
    n, width = 400, 30
    rows, columns = np.nonzero(rng.random((n, width)) < 0.2)
    values, y = rng.normal(0, 3, width)[columns], (np.arange(n) % 9 == 0).astype(float)
    w, bias = toxicity._regression(rows, columns, values, y, width)
    z = np.bincount(rows, values * w[columns], n) + bias
    error = np.where(y > 0, toxicity.RARE_WEIGHT, 1.0) * (1 / (1 + np.exp(-z)) - y)
    slope = np.bincount(columns, values * error[rows], width) / n + toxicity.PENALTY * w
    assert np.abs(slope).max() < 1e-6 and abs(error.mean()) < 1e-6


def test_long_text_scores_as_a_whole(spark):
    model = toxicity.Model(np.zeros(toxicity.SLOTS), -1.0)
    slots = next(iter(toxicity.features(["zq"])))
    model.weights[slots] = 1.0
    plain = "ab " * 200_000
    assert toxicity.scores([plain, plain + "zq"], model)[0] < toxicity.scores([plain, plain + "zq"], model)[1]


def test_cross_entropy(documents, rows):
    target = documents.filter("doc_id in (1, 11)").select("doc_id")
    got = cross_entropy.score(documents, target).collect()
    texts = [(i, brute.spaced((t or "").translate(brute.LOWER))) for i, t in rows]
    types = len({w for _, ws in texts for w in ws}) + 1

    def losses(chosen):
        def counted(several):
            words, pairs = Counter(), Counter()
            for ws in several:
                if ws:
                    words.update([*ws, None])
                    pairs.update(zip([None, *ws], [*ws, None]))
            return words, pairs

        words, pairs = counted(ws for _, ws in chosen)
        n, out = sum(words.values()), []
        for i, ws in texts:
            own, both = counted([ws] if (i, ws) in chosen else [])
            m = n - sum(own.values())

            def p(v, w):
                single = (words[w] - own[w] + 1) / (m + types)
                return (pairs[v, w] - both[v, w] + 10 * single) / (words[v] - own[v] + 10)

            out.append(-np.mean([np.log(p(v, w)) for v, w in zip([None, *ws], [*ws, None])]) if ws else None)
        return out

    def tidy(x):
        return None if x is None else round(float(x), 6)

    want = zip(texts, losses([x for x in texts if x[0] in (1, 11)]), losses(texts))
    same(
        [(r.doc_id, r.n_tokens, tidy(r.target_loss), tidy(r.background_loss)) for r in got],
        [(i, len(ws) + 1 if ws else 0, tidy(a), tidy(b)) for (i, ws), a, b in want],
    )


def test_documents_in_slices_lose_the_same(rows, monkeypatch):
    table = pa.table({"chunk": pa.array([0] * len(rows), pa.int32()), "id": [i for i, _ in rows], "text": [t or "" for _, t in rows]})
    chosen = pa.table({"chunk": pa.array([0, 0, 0], pa.int32()), "id": [1, 11, 14]})
    answers = cross_entropy._answer(1)(cross_entropy._send(1)(table, chosen))
    told = pa.concat_tables([answers, chosen], promote_options="default")
    whole = cross_entropy._losses(1)(table, told)
    tokens = cross_entropy._keys(table.column("text"))[-1]
    assert len(list(cross_entropy._slices(tokens))) == 1
    monkeypatch.setattr(cross_entropy, "SLICE", 7)
    assert len(list(cross_entropy._slices(tokens))) > 10
    cut = cross_entropy._losses(1)(table, told)
    for name in ("target_loss", "background_loss"):
        a, b = (t.column(name).to_numpy(zero_copy_only=False) for t in (whole, cut))
        assert np.allclose(a, b, rtol=0, atol=1e-12, equal_nan=True)


def test_only_the_copy_of_a_text_lowers_its_loss(spark):
    said = [" ".join(f"w{(k * 37 + j * j) % 997}" for j in range(80)) for k in range(40)]
    once = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")
    twice = once.unionByName(once.filter("doc_id = 7").selectExpr("doc_id + 100 AS doc_id", "text"))
    loss = {r.doc_id: r.background_loss for r in cross_entropy.score(twice, once.filter("doc_id < 3")).collect()}
    assert loss[7] == loss[107] < min(v for k, v in loss.items() if k not in (7, 107)) - 1


def test_perspectives(spark):
    turns = [
        (1, 0, "system", "Be kind."), (1, 1, "ann", "Hi"), (1, 2, "bob", None), (1, 2, "bob", None), (1, 2, "ann", "tie"),
        (1, 300, "cy\nd", "x<|im_end|>"), (2, 0, "system", "alone"), (None, 0, "ann", "null"), (3, None, None, "y"),
    ]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("said", F.lit(1))
    got = {(r.conv_id, r.perspective, r.part): r for r in perspective.rotate(frame).collect()}
    assert set(got) == {(1, p, 0) for p in ("ann", "bob", "cy\nd")} | {(None, "ann", 0), (3, "unknown", 0)}
    own = got[1, "ann", 0]
    assert own.text == (
        "<|im_start|>system\nBe kind.<|im_end|>\n<|im_start|>assistant\nHi<|im_end|>\n"
        "<|im_start|>assistant\ntie<|im_end|>\n<|im_start|>user name=bob\n<|im_end|>\n"
        "<|im_start|>user name=cy d\nx<im_end><|im_end|>\n"
    )
    assert [own.text[m.start : m.end] for m in own["mask"]] == ["Hi<|im_end|>", "tie<|im_end|>"]
    assert (own.n_turns, own.n_own_turns) == (5, 2)


def parts_of(frame):
    """Per dialogue and participant the bodies said, part by part."""
    got = {}
    for r in perspective.rotate(frame).collect():
        bodies = [t.split("\n", 1)[1] for t in r.text.removesuffix("<|im_end|>\n").split("<|im_end|>\n")]
        assert len(bodies) == r.n_turns <= 256 and all(r.text[m.start : m.end].endswith("<|im_end|>") for m in r["mask"])
        assert len(r["mask"]) == r.n_own_turns
        assert got.setdefault((r.conv_id, r.perspective), {}).setdefault(r.part, bodies) is bodies
    return got


def test_perspectives_at_the_border_of_parts(spark):
    """A dialogue of 256 turns is one part, one turn more makes a second; turn numbers may leave gaps and repeat rows."""
    turns = [(n, 1000 * k, "ab"[k % 2], str(k)) for n in (255, 256, 257) for k in range(n)]
    got = parts_of(spark.createDataFrame(turns * 2, "conv_id long, turn long, role string, text string"))
    for n in (255, 256, 257):
        for who in "ab":
            want = [str(k) for k in range(n)]
            assert got[n, who] == {0: want[:256], **({1: want[256:]} if n > 256 else {})}


@pytest.mark.parametrize("conv_id, turn", [(7, 5), (7, None), (None, None)])
def test_many_rows_at_one_turn(spark, conv_id, turn):
    """Rows at one turn number, or without a dialogue, are cut by their place like all others, in order of speaker and digest."""
    said = [("ab"[k % 2], f"text {k}") for k in range(10_000)]
    frame = spark.createDataFrame([(conv_id, turn, *s) for s in said], "conv_id long, turn long, role string, text string")
    got = parts_of(frame.repartition(5))
    want = [t for _, t in sorted(said, key=lambda s: (s[0], brute.digest(s[1])))]
    assert set(got) == {(conv_id, "a"), (conv_id, "b")}
    for parts in got.values():
        assert parts == {p: want[256 * p : 256 * p + 256] for p in range(40)}


def test_entities(spark):
    """Against the standard library's reading; what has no semicolon or no known name stays."""
    texts = [
        "caf&eacute; &#8217;&#x2019;&#X1f600; &amp;lt; &lt;b&gt; &Omega;&hearts;", "&nbsp;a&#160;b&#xA0;c", "& &; &# &#; &#x; AT&T &copy 1",
        "&apos;&#39;&quot;", "&amp;&amp;", "x &unknownname; y", "&#0;&#xD800;&#x110000;",
    ]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = [r.v for r in frame.select("k", warc.resolved(F.col("t")).alias("v")).orderBy("k").collect()]
    for text, value in zip(texts, got):
        assert value == (text if text.startswith("& ") else unescape(text).replace("\xa0", " "))


class PageText(HTMLParser):
    """The text of a page by the standard library's parser."""

    def __init__(self, html):
        super().__init__()
        self.out, self.depth = [], 0
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.depth += tag in warc.SILENT
        if tag in warc.BREAKING:
            self.out.append("\n")

    def handle_endtag(self, tag):
        self.depth -= tag in warc.SILENT and self.depth > 0
        if tag in warc.BREAKING:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.depth:
            self.out.append(" ".join(f".{data}.".split())[1:-1].replace("\xa0", " "))

    def lines(self):
        lines = (" ".join(line.split(" ")).strip(" ") for line in "".join(self.out).split("\n"))
        return "\n".join(" ".join(line.split()) for line in lines if line)


def test_page_text_by_a_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    texts = {r.source_id: r.block for r in warc.derive(warc.responses(pages)).filter("warc_type = 'conversion'").collect()}
    other = [r.page_id for r in pages.collect() if texts[r.page_id] != PageText(r.html or "").lines()]
    assert len(texts) > 100 and not other


def test_warc(spark, tmp_path):
    html = (
        "<!DOCTYPE html><html lang=\"DE\"><head><title> A &amp; B\n</title></head><body><!-- <p>no</p> --><script>var t='</p>';</script>"
        "<p>One  two<br>three &lt;b&gt; &amp;amp;</p><a href='/x'>link</a><style>p{}</style></body></html>"
    )
    pages = spark.createDataFrame([(1, "http://a", html), (2, None, None), (2, None, None), (None, "http://b", "")], "page_id long, url string, html string")
    records = warc.responses(pages.withColumn("payload", F.lit("x")).withColumn("block", F.lit("y")))
    got = warc.derive(records).collect()
    assert len(got) == 8
    meta, text = sorted((r for r in got if r.source_id == 1), key=lambda r: r.warc_type, reverse=True)
    assert text.block == "One two\nthree <b> &amp;\nlink"
    assert "title: A &amp; B" in meta.block and "languages: de" in meta.block and "outlinks: 1" in meta.block
    source = records.filter("source_id = 1").first()
    for r, other in ((meta, text), (text, meta)):
        assert r.refers_to == source.record_id and r.payload_digest == source.payload_digest and r.date == warc.UNDATED
        assert r.concurrent_to == (other.record_id if r is meta else None)
        assert r.block_digest == "sha256:" + brute.digest(r.block) and r.content_length == len(r.block.encode())
    assert {r.block for r in got if r.source_id == 2 and r.warc_type == "conversion"} == {""}
    kept = records.withColumns({"payload_digest": F.lit("sha1:ABC"), "date": F.lit("2024-01-01T00:00:00Z")})
    assert {(r.payload_digest, r.date) for r in warc.derive(kept).collect()} == {("sha1:ABC", "2024-01-01T00:00:00Z")}
    warc.write(warc.derive(records).filter("source_id = 1"), str(tmp_path / "out"), "none")
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("part-*")))
    found = []
    while data:  # read back by Content-Length
        head, _, rest = data.partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        n = int(fields["Content-Length"])
        assert head.startswith(b"WARC/1.1\r\n") and rest[n : n + 4] == b"\r\n\r\n"
        found.append((fields["WARC-Type"], rest[:n].decode()))
        data = rest[n + 4 :]
    same(found, [("metadata", meta.block), ("conversion", text.block)])


def test_empty_tables(spark, documents):
    none = documents.limit(0)
    items = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    ledger = secret_ledger.scan(none)
    for frame in (
        quality_rules.assess(none), ledger, secret_ledger.findings(none, ledger, path_col="doc_id"), secret_ledger.redact(none),
        winnowing.hits(none, items), near_dup.group(none), near_dup.clean(none), substring.remove_repeats(none),
        packing.pack(none, TOKENIZER), toxicity.score(none, toxicity.train(none, labels)), cross_entropy.score(none, labels),
        perspective.rotate(turns), warc.derive(warc.responses(pages)),
    ):
        assert frame.count() == 0
    got = winnowing.hits(documents, items).collect()
    assert not any(r.contaminated for r in got)
    scored = toxicity.score(documents, toxicity.train(documents, labels), score_col="found")
    assert scored.agg(F.max("found")).first()[0] < 1e-6

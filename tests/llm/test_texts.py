"""Operators 2, 3, 4, 8 and 10: exact round trips, brute force and held-out accuracy."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cliplab.llm import fingerprints, language, main_text, pieces, pseudo_likelihood

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ------------------------------------------------------------------ sentencepiece


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


def test_ids_equal_the_library_and_decode_to_the_text(library, some):
    encoder = pieces.Encoder(pieces.load(pieces.MODEL))
    rng = random.Random(2)
    parts = ["a", "b", "the", "ing", "  ", " ", "\n", "\t", "é", "日", "\U0001f642", "====", "0", ".", "   ", "xyz", "__"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(50))) for _ in range(800)]
    texts += [r.text for r in some.collect()] + [" " * 300, "a" * 3000, "".join(rng.choice("abcdefgh") for _ in range(5000))]
    for text, want in zip(texts, library.encode(texts), strict=True):
        got = encoder.ids(text)
        assert got == want, text[:80]
        assert encoder.text(got) == text


def test_stream_equals_the_short_search_and_commits_early():
    encoder = pieces.Encoder(pieces.load(pieces.MODEL))
    rng = random.Random(4)
    for _ in range(200):
        text = "".join(rng.choice("aeinorst") for _ in range(rng.randrange(1, 64)))
        assert list(encoder.stream(text)) == encoder._short(text)
    taken = 0

    def characters():
        nonlocal taken
        for c in "a long run of words " * 50:
            taken += 1
            yield c.replace(" ", pieces.SPACE_MARK)

    first = next(encoder.stream(characters()))
    assert first >= 0 and taken < 3 * encoder.v.longest


def brute_unigram(text, plain, scores, worst):
    best = [(0.0, [])]
    for end in range(1, len(text) + 1):
        options = []
        for size in range(1, min(8, end) + 1):
            piece = plain.get(text[end - size : end])
            if piece is not None:
                options.append((best[end - size][0] + scores[piece], best[end - size][1] + [piece]))
        if text[end - 1] not in plain:
            options.append((best[end - 1][0] + worst, best[end - 1][1] + [0]))
        best.append(max(options, key=lambda o: o[0]))
    return best[-1]


def test_unigram_search_finds_the_best_path():
    rng = random.Random(5)
    names = ["<unk>", pieces.SPACE_MARK, *"abcd", "ab", "abc", "bcd", "cd", "da", "dab", pieces.SPACE_MARK + "a", "bb"]
    scores = [0.0] + [-round(rng.uniform(1, 9), 3) for _ in names[1:]]
    plain = {p: i for i, p in enumerate(names) if i}
    v = pieces.Vocabulary(names, scores, [], plain, True, 0)
    encoder = pieces.Encoder(v)
    for _ in range(300):
        text = "".join(rng.choice("abcd e") for _ in range(rng.randrange(1, 60)))
        marked = pieces.SPACE_MARK + text.replace(" ", pieces.SPACE_MARK)
        score, _ = brute_unigram(marked, plain, scores, v.worst)
        got = encoder.ids(text)
        total = sum(scores[i] if i else v.worst for i in got)
        assert total == pytest.approx(score)


def test_encode_and_decode_of_edge_cases(edge, nothing):
    coded = pieces.encode(edge.withColumn("ids", F.lit("clash")), check=True)
    rows = coded.collect()
    assert all(r.round_trip for r in rows) and len(rows) == edge.count()
    assert {r.doc_id: r.ids for r in rows}[4] == [] and {r.doc_id: r.ids for r in rows}[5] == []
    back = {(r.doc_id, r.decoded) for r in pieces.decode(coded).collect()}
    assert back == {(r.doc_id, r.text or "") for r in edge.collect()}
    assert pieces.encode(nothing).count() == 0 and pieces.decode(pieces.encode(nothing)).count() == 0


# ------------------------------------------------------------------ fingerprints


def weights(text, n=5):
    w = WORD.findall(text or "")
    return collections.Counter([tuple(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [tuple(w)] if w else [])


def jaccard(a, b):
    keys = set(a) | set(b)
    return sum(min(a[k], b[k]) for k in keys) / sum(max(a[k], b[k]) for k in keys) if keys else 1.0


def by_descending_id(rows):
    return sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or ""))


def test_fingerprints_estimate_generalised_jaccard(some):
    rows = by_descending_id([(r.doc_id, r.text) for r in some.collect()])
    got = {r.doc_id: r for r in fingerprints.edited_pairs(some).collect()}
    errors = []
    for i, (doc, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        third = len(text) // 3
        new = text[: len(text) - third] + following[:third]
        r = got[doc]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(new.encode()).hexdigest())
        errors.append(r.near_edited - jaccard(weights(text), weights(new)))
        errors.append(r.near_next - jaccard(weights(text), weights(following)))
    errors = np.array(errors)
    assert abs(errors.mean()) < 0.005 and np.sqrt((errors**2).mean()) < 0.05


def test_weights_count():
    draws = fingerprints.Draws(3)
    rng = np.random.default_rng(0)
    errors = []
    for _ in range(60):
        terms = np.unique(rng.integers(0, 2**63, 40).astype(np.uint64))
        a, b = rng.integers(1, 9, len(terms)), rng.integers(1, 9, len(terms))
        alike = fingerprints.likeness(draws.sample(terms, a), draws.sample(terms, b))
        errors.append(alike - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 0.02


def test_fingerprints_of_edge_cases(edge, nothing, spark):
    rows = [tuple(r) for r in fingerprints.edited_pairs(edge).select("doc_id", "fingerprint", "near_next", "near_edited", "n_chars").collect()]
    assert len(rows) == edge.count() and all(0 <= r[2] <= 1 and 0 <= r[3] <= 1 for r in rows)
    prints = {r[0]: r[1] for r in rows}
    assert prints[1] == prints[2] != prints[3] and prints[4] == prints[5] == prints[7]
    assert {r[0]: r[2] for r in rows}[2] == 1.0  # the next document is its copy
    assert fingerprints.edited_pairs(nothing).count() == 0
    single = fingerprints.edited_pairs(spark.createDataFrame([(5, "a b c d e f")], "doc_id long, text string")).collect()
    assert len(single) == 1 and single[0].near_next == 1.0
    far = spark.createDataFrame([(-(2**62), "a"), (2**62, "b"), (0, "c")], "doc_id long, text string")
    assert fingerprints.edited_pairs(far).count() == 3


@pytest.mark.parametrize("pieces", [4, 100_000])
def test_ranges_stay_small_for_any_spread_of_ids(spark, monkeypatch, pieces):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 16)
    monkeypatch.setattr(fingerprints, "PIECE_RANGES", pieces)
    ids = [*range(500), 10**15, 10**15 + 1, -(2**62), *range(2**62, 2**62 + 90), *[None] * 100]
    rows = [(d, f"text {i} of many") for i, d in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    placed = fingerprints._ranges(docs).collect()
    sizes = collections.Counter(tuple(r.place) for r in placed)
    assert len(placed) == len(rows) and max(sizes.values()) <= 32
    known = sorted((tuple(r.place), r.at) for r in placed)
    assert [a for p, a in known if p[0] == 1] == sorted(d for d in ids if d is not None)
    got = fingerprints.edited_pairs(docs).collect()
    assert len(got) == len(rows)
    last = {d: t for d, t in rows if d is not None}
    down = sorted(last, reverse=True)
    edited = {d: fingerprints.edited(last[d], last[n]) for d, n in zip(down, down[1:], strict=False)}
    assert {r.doc_id: r.edited_sha256 for r in got if r.doc_id in edited} == {d: hashlib.sha256(t.encode()).hexdigest() for d, t in edited.items()}
    first = spark.createDataFrame([r for r in rows if r[0] is not None], "doc_id long, text string")
    lowest = [r for r in fingerprints.edited_pairs(first).collect() if r.doc_id == down[-1]]
    assert lowest[0].edited_sha256 == hashlib.sha256(fingerprints.edited(last[down[-1]], last[down[0]]).encode()).hexdigest()


# ------------------------------------------------------------------ language


def test_gradients_are_those_of_the_loss():
    network = language.LanguageNetwork(["a", "b", "c"], 3, 1)
    for r in (network.forward, network.reverse):
        r.inputs, r.hidden_weights = r.inputs.astype(np.float64), r.hidden_weights.astype(np.float64)
    rng = np.random.default_rng(0)
    codes = rng.integers(97, 103, (6, 4)).astype(np.uint8)
    above = rng.standard_normal((6, 4, 3))
    loss = lambda: float((network.forward.run(codes).astype(np.float64) * above).sum())
    got = network.forward.backward(codes, network.forward.run(codes), above)
    for weights_, grad in zip(network.forward.parameters, got, strict=True):
        for at in [(98 if len(weights_) > 100 else 1, 2), (99 if len(weights_) > 100 else 0, 7)]:
            old = weights_[at]
            weights_[at] = old + 1e-2
            up = loss()
            weights_[at] = old - 1e-2
            down = loss()
            weights_[at] = old
            assert grad[at] == pytest.approx((up - down) / 2e-2, rel=0.05, abs=5e-3)


def test_held_out_accuracy(some):
    rows = language.with_language(some).withColumn("held_out", language.held_out(F.col("doc_id"))).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == some.count() and 40 < len(held) < 95
    assert np.mean([r.lang_pred == r.lang for r in held]) >= 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_edge_cases(edge, nothing):
    rows = language.with_language(edge.withColumn("score", F.lit("clash")), epochs=1).collect()
    und = {r.doc_id for r in rows if r.lang_pred == "und"}
    assert len(rows) == edge.count() and und == {4, 5, 7, 10}
    assert all(r.score == 0 for r in rows if r.lang_pred == "und")
    assert language.with_language(nothing).count() == 0
    unlabelled = language.with_language(edge.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"}
    assert language.in_known_language(edge).columns == edge.columns


# ------------------------------------------------------------------ pseudo-likelihood


def test_scores_are_sums_of_conditionals(edge, some):
    classes, of_class, of_token = pseudo_likelihood.train(some, epochs=3)
    assert np.allclose(np.exp(of_class).sum(axis=1), 1, atol=1e-3)
    assert np.allclose(np.bincount(classes, np.exp(of_token), pseudo_likelihood.CLASSES)[1:], 1, atol=1e-2)
    got = {r.doc_id: r for r in pseudo_likelihood.score(some, epochs=3).collect()}
    import pyarrow as pa

    from cliplab.llm.words import Words, text_buffers

    for row in some.limit(8).collect():
        token = pseudo_likelihood.tokens(Words(*text_buffers(pa.array([row.text]))))
        own, total, r = classes[token], 0.0, pseudo_likelihood.RADIUS
        for i in range(len(own)):
            context = 0
            for j in [*range(i - r, i), *range(i + 1, i + r + 1)]:
                context = context * pseudo_likelihood.CLASSES + (own[j] if 0 <= j < len(own) else 0)
            total += of_class[context, own[i]] + of_token[token[i]]
        assert got[row.doc_id].log_probability == pytest.approx(total, rel=1e-4)
        assert got[row.doc_id].n_tokens == len(own)


def test_network_learns_both_sides():
    """A pattern that only both neighbours together tell."""
    rng = np.random.default_rng(0)
    a, b = rng.integers(1, 3, 4000), rng.integers(1, 3, 4000)
    target = np.where(a == b, 3, 4)
    context = a * pseudo_likelihood.CLASSES**2 + b * pseudo_likelihood.CLASSES
    network = pseudo_likelihood.WindowNetwork(16, 2)
    network.fit(context, target, np.ones(4000), epochs=400)
    log_p, _ = network.log_probabilities(context)
    assert np.exp(log_p[np.arange(4000), target]).min() > 0.9


def test_scores_of_edge_cases(edge, nothing):
    rows = {r.doc_id: r for r in pseudo_likelihood.score(edge, epochs=1).collect()}
    assert (rows[4].n_tokens, rows[4].log_probability, rows[4].mean_log_probability) == (0, 0.0, None)
    assert rows[1].log_probability < 0 and rows[1].log_probability == rows[2].log_probability
    assert pseudo_likelihood.score(nothing, epochs=1).count() == 0


@pytest.mark.parametrize(("head", "hot"), [(200_000, 4096), (300, 20), (0, 0)])
def test_word_scores_equal_counts_of_true_words(some, monkeypatch, head, hot):
    from collections import Counter

    import pyarrow as pa

    from cliplab.llm.words import Words, text_buffers

    monkeypatch.setattr(pseudo_likelihood, "HEAD_WORDS", head)
    monkeypatch.setattr(pseudo_likelihood, "HOT_WORDS", hot)
    vocabulary, of_class, _, _ = pseudo_likelihood.word_model(some, epochs=1)
    texts = {r.doc_id: r.text for r in some.collect()}
    spelled = {d: WORD.findall(t or "") for d, t in texts.items()}
    classes = {d: vocabulary.of(Words(*text_buffers(pa.array([t]))).hashes)[0].tolist() for d, t in texts.items()}
    of_word = {w: c for d in texts for w, c in zip(spelled[d], classes[d], strict=True)}
    single, between, by_side, size, kinds = Counter(), Counter(), Counter(), Counter(), Counter(of_word.values())
    side = lambda own, i: (own[i - 1] if i else 0, own[i + 1] if i + 1 < len(own) else 0)
    for d, words in spelled.items():
        for i, w in enumerate(words):
            s = side(classes[d], i)
            single[w] += 1
            between[s, w] += 1
            by_side[s, of_word[w]] += 1
            size[of_word[w]] += 1
    got = {r.doc_id: r for r in pseudo_likelihood.word_scores(some, epochs=1).collect()}
    assert set(got) == set(texts)
    for d in list(texts)[:25]:
        own, total = classes[d], 0.0
        for i, w in enumerate(spelled[d]):
            context = 0
            for j in (i - 2, i - 1, i + 1, i + 2):
                context = context * pseudo_likelihood.CLASSES + (own[j] if 0 <= j < len(own) else 0)
            c, s, k = own[i], side(own, i), pseudo_likelihood.PRIOR
            total += of_class[context, c] + np.log((between[s, w] - 1 + k * single[w] / (size[c] - 1 + kinds[c])) / (by_side[s, c] - 1 + k))
        assert (got[d].n_tokens, got[d].log_probability) == (len(own), pytest.approx(total, rel=1e-5))


def test_a_rare_word_at_the_address_of_a_frequent_one_scores_by_its_own_count(spark):
    import pyarrow as pa

    from cliplab.llm.words import Words, text_buffers

    names = [f"q{i}" for i in range(200_000)]
    address = pseudo_likelihood.tokens(Words(*text_buffers(pa.array([" ".join(names)]))))
    rare = names[int(np.flatnonzero(address == address[0])[1])]
    rows = [(0, f"a b {names[0]} c d"), (1, f"a b {rare} c d")] + [(i, f"a b {names[0]} c d") for i in range(2, 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.log_probability for r in pseudo_likelihood.word_scores(docs, epochs=3).collect()}
    assert got[1] < got[0] - 1


def test_word_scores_of_edge_cases(edge, nothing):
    rows = pseudo_likelihood.word_scores(edge, epochs=1).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in edge.collect())
    by_id = {r.doc_id: r for r in rows}
    assert (by_id[4].n_tokens, by_id[4].log_probability, by_id[4].mean_log_probability) == (0, 0.0, None)
    assert by_id[1].log_probability < 0 and by_id[1].log_probability == by_id[2].log_probability
    assert by_id[None].n_tokens == 3
    assert pseudo_likelihood.word_scores(nothing, epochs=1).count() == 0


# ------------------------------------------------------------------ main text


PROSE = "A long sentence, with commas, and clauses, and more, goes on, and on, for a while, until it ends. " * 4


def test_an_article_keeps_short_sections_beside_a_long_one():
    long = "".join(f"<p>{i} {PROSE}</p>" for i in range(12))
    html = (
        f"<body><article><h1>Title</h1><section><p>Short one.</p></section><section>{long}</section><blockquote>Said so</blockquote>"
        "<pre>x = 1</pre><table><tr><td>cell</td></tr></table><div><p>Last words.</p></div>"
        "<div><a href=a>Other page</a> <a href=b>More pages</a></div></article></body>"
    )
    got = main_text.main_blocks(html)
    assert [b for b in got if "commas" not in b] == ["Title", "Short one.", "Said so", "x = 1", "cell", "Last words."]
    assert len(got) == 18


@pytest.mark.parametrize(
    ("attributes", "shown"),
    [
        ('style="overflow: hidden"', True), ('title="hidden gems"', True), ("data-hidden='1'", True), ('data-x="display:none"', True),
        ("hidden", False), ('class="x" HIDDEN', False), ('hidden=""', False), ("hidden=hidden class=x", False),
        ('style="color: red; display : none"', False), ("style='visibility: hidden'", False),
    ],
)
def test_only_hidden_elements_are_hidden(attributes, shown):
    assert main_text.main_blocks(f"<body><div {attributes}><p>{PROSE}</p></div></body>") == ([PROSE.strip()] if shown else [])


def test_quotes_code_and_lists_beside_the_best_container():
    long = "".join(f"<p>{i} {PROSE}</p>" for i in range(12))
    html = f"<body><div><blockquote><p>She said so.</p></blockquote><div>{long}</div><pre>y = 2</pre><ul><li>It holds.</li></ul><ul><li><a href=a>Link.</a></li></ul></div></body>"
    got = main_text.main_blocks(html)
    assert [b for b in got if "commas" not in b] == ["She said so.", "y = 2", "It holds."]


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (None, []), ("", []), ("<html><body></body></html>", []), ("plain &amp; <b>bold</b>", ["plain & bold"]),
        ("<article><h1>T</h1><p><b>a<br>b<p>c &lt; d&nbsp;e</article><footer>f</footer>", ["T", "a b", "c < d e"]),
        ("<nav>m</nav><div class='ad'>buy, now</div><article><p>x, y, z.</p></article><div id=comments><p>me, too, yes.</p></div>", ["x, y, z."]),
        ("<body><script>if (a<b) '<p>no</p>'</script><style>p{}</style><p>yes, it is.</p></body>", ["yes, it is."]),
        ("<article><p>cut off, here &am", ["cut off, here &am"]), ("<article><p>cut in a <a hre", ["cut in a"]),
        ("<article><p>one, two.</p><form><p>your name, please.</p></form><ul><li>x<li>y</ul></article>", ["one, two.", "x", "y"]),
        ("<p>a<p>b", ["a", "b"]), ('<p title="never closed>text, one</p><p>two</p>', None),
        ("<main><header><h1>H</h1></header><p>Long text, with commas, here.</p></main><aside>s</aside>", ["H", "Long text, with commas, here."]),
        ("<div><p>" + "word, " * 60 + "</p></div><div class=related><a href=x>more, more, more</a></div>", [("word, " * 60).strip()]),
    ],
)
def test_main_blocks(html, want):
    got = main_text.main_blocks(html or "")
    assert want is None or got == want


def test_deep_pages_do_not_fail():
    assert main_text.main_blocks("<div>" * 3000 + "<p>deep, down.</p>") == ["deep, down."]
    assert main_text.main_blocks("<" * 2000 + "<a " * 500)[:0] == []


def test_pages_of_edge_cases(spark):
    rows = [(1, None, "<p>x</p>", "k"), (None, "u", None, "k"), (2, "u", "", None), (2, "u", "", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((tuple(r) for r in main_text.extract_main_text(pages).collect()), key=str)
    assert got == sorted([(1, None, "x", 1), (None, "u", "", 0), (2, "u", "", 0), (2, "u", "", 0)], key=str)
    assert main_text.extract_main_text(pages.limit(0)).count() == 0


LONG_PROSE = "The river rose again in the night, and by morning the lower fields were under water. " * 3


@pytest.mark.parametrize(
    ("before", "after"),
    [
        ('<div class="container sidebar-right">', "</div>"), ('<div class="post no-comments">', "</div>"), ('<div class="content-sidebar">', "</div>"),
        ('<form id="aspnetForm"><input name="q">', "</form>"), ('<div class="has-sidebar"><div class="widget-content">', "</div></div>"),
    ],
)
@pytest.mark.parametrize("tag", ["article", "div"])
def test_names_and_forms_around_the_article_do_not_remove_it(before, after, tag):
    html = f"<body>{before}<{tag}><h1>Flood</h1><p>{LONG_PROSE}</p></{tag}><div class='sidebar-right'><p>Read our other, shorter, stories.</p></div>{after}</body>"
    assert main_text.main_blocks(html) == ["Flood", LONG_PROSE.strip()]


@pytest.mark.parametrize("name", ['class="share-price"', 'id="legal"', 'class="related-work"', 'class="no-comments"'])
def test_sections_named_by_their_topic_stay(name):
    html = f"<article><h1>Flood</h1><p>{LONG_PROSE}</p><section {name}><h2>More</h2><p>{LONG_PROSE}</p></section></article>"
    assert main_text.main_blocks(html) == ["Flood", LONG_PROSE.strip(), "More", LONG_PROSE.strip()]


@pytest.mark.parametrize("name", ['class="share"', 'class="related posts"', 'id="social-links"', 'class="newsletter"', 'class="cookie-notice"'])
def test_furniture_inside_the_article_goes(name):
    html = f"<article><h1>Flood</h1><p>{LONG_PROSE}</p><div {name}><p>Tell <a href=a>friends</a> now.</p></div></article>"
    assert main_text.main_blocks(html) == ["Flood", LONG_PROSE.strip()]


@pytest.mark.parametrize("name", ['class="commentlist"', 'id="comments"', 'class="talk"', ""])
def test_comments_go_by_name_or_form(name):
    item = f'<li><span class="author">Kim</span> <time>1 May</time><p>{LONG_PROSE * 4}</p></li>'
    html = f"<body><article><h1>Flood</h1><p>{LONG_PROSE}</p></article><ol {name}>{item}{item}</ol></body>"
    assert main_text.main_blocks(html) == ["Flood", LONG_PROSE.strip()]
    assert main_text.main_blocks(html.replace("article>", "div>")) == ["Flood", LONG_PROSE.strip()]


def test_a_slash_closes_only_void_elements():
    (line,) = main_text.parse("<p><a href=x/>one</a><br/>two</p>").parts
    assert [p if isinstance(p, str) else (p.tag, p.parts) for p in line.parts] == [("a", ["one"]), ("br", []), "two"]


def test_the_header_of_an_entry_is_its_own():
    html = f'<body><header><p>Site name.</p></header><div class="post"><header><h1>Flood</h1></header><p>{LONG_PROSE}</p></div></body>'
    assert main_text.main_blocks(html) == ["Flood", LONG_PROSE.strip()]

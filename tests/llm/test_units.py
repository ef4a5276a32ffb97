"""Parts without Spark: hashing, signatures, grammar, packing, schedules, bundles, pages, urls, windows."""

import itertools
import random
from fractions import Fraction

import numpy as np
import pytest

from opinara.llm import components, embedding_dedup, fingerprints, html_template, mixing, near_dedup, packing, shingles, token_store, tokens, toxicity, url_filter, warc
from tests.llm.brute import shingle_set, words_of

TEXTS = [None, "", " \t\n", "one", "One  TWO", "a b c d e", "A b c d e f", "é è ü straße " * 30, "x" * 5000, "w " * 3000, "a b c d e\x0bf\x0cg h"]


def sets_of(texts):
    raw, offsets = shingles.from_texts(texts)
    flat, counts = shingles.shingle_hashes(raw, offsets)
    return np.split(flat, np.cumsum(counts)[:-1]), flat, counts


def test_shingles_match_the_definition():
    rng = random.Random(3)
    texts = TEXTS + [" ".join(rng.choice(["al", "Be", "ga", "dé"]) for _ in range(rng.randrange(40))) for _ in range(60)]
    sets, _, counts = sets_of(texts)
    named = [shingle_set(t) for t in texts]
    assert counts.tolist() == [len(s) for s in named]
    for i, j in itertools.combinations(range(len(texts)), 2):
        common, union = shingles.jaccard_counts(sets[i], sets[j])
        assert (common, union) == (len(named[i] & named[j]), len(named[i] | named[j]))
    # the same hashes whatever stands around a document
    alone = [sets_of([t])[0][0].tolist() for t in texts]
    assert alone == [s.tolist() for s in sets]
    assert words_of("A\u00a0b c") == ["a\u00a0b", "c"]


@pytest.mark.parametrize("signer", [near_dedup.super_minhash, lambda f, c: fingerprints.minhash(f, c, 256)])
def test_signatures_estimate_similarity(signer):
    rng = random.Random(5)
    errors = []
    for share in (0.2, 0.5, 0.75, 0.9):
        for n in (8, 100, 3000):
            both = {rng.getrandbits(64) for _ in range(int(n * share))}
            a, b = (both | {rng.getrandbits(64) for _ in range((n - len(both)) // 2)} for _ in range(2))
            rows = [np.array(sorted(x), dtype=np.uint64) for x in (a, b)]
            sig = signer(np.concatenate(rows), np.array([len(r) for r in rows]))
            errors.append(float((sig[0] == sig[1]).mean()) - len(a & b) / len(a | b))
    assert max(map(abs, errors)) < 0.15 and abs(np.mean(errors)) < 0.03


def test_long_texts_are_hashed_in_slices(monkeypatch):
    rng = random.Random(7)
    texts = TEXTS + [" ".join(rng.choice(["al", "Be", "ga", "dé", "x" * 90]) + str(rng.randrange(9)) for _ in range(k)) for k in (3, 400, 5, 900)] + ["y" * 3000]
    sets, flat, counts = sets_of(texts)
    sig = near_dedup.super_minhash(flat, counts)
    for size in (16, 100, 1000):
        monkeypatch.setattr(shingles, "SLICE_BYTES", size)
        monkeypatch.setattr(near_dedup, "SLICE", size)
        again, flat2, counts2 = sets_of(texts)
        assert [s.tolist() for s in again] == [s.tolist() for s in sets]
        assert (near_dedup.super_minhash(flat2, counts2) == sig).all()


def test_super_minhash_of_edges():
    _, flat, counts = sets_of(TEXTS)
    sig = near_dedup.super_minhash(flat, counts)
    assert np.isinf(sig[counts == 0]).all() and np.isfinite(sig[counts > 0]).all()
    single = sig[TEXTS.index("one")]
    assert sorted(np.floor(single).astype(int)) == list(range(near_dedup.SLOTS))  # a permutation of ranks


def test_union_find():
    nodes, root = components.roots(np.array([5, 7, 2, 9]), np.array([3, 5, 2, 8]))
    assert dict(zip(nodes.tolist(), root.tolist(), strict=True)) == {2: 2, 3: 3, 5: 3, 7: 3, 8: 8, 9: 8}
    assert components.roots(np.empty(0, int), np.empty(0, int))[0].size == 0


def test_fingerprint_edges():
    prints = fingerprints.of_texts(TEXTS + ["one"])
    assert not prints[0].any() and (prints[TEXTS.index("one")] == prints[-1]).all()
    empty, other = prints[:1], prints[3:4]
    assert fingerprints.likeness(empty, empty)[0] == 1.0 and fingerprints.likeness(empty, other)[0] == 0.0
    assert fingerprints.edited("abcdefg", "XY") == "abcdeXY" and fingerprints.edited("abcdefghi", "Z") == "abcdefZ"


def test_link_block_keeps_connectivity():
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(60)]
    sets = [np.array(sorted(rng.sample(base, 55) + [rng.getrandbits(64) for _ in range(rng.randrange(20))]), dtype=np.uint64) for _ in range(40)]
    ids = np.arange(100, 140)
    a, b = near_dedup.link_block(ids, sets, ids, 75)
    want_a, want_b = zip(*[(i, j) for i, j in itertools.combinations(range(40), 2) if (lambda c: 100 * c[0] >= 75 * c[1])(shingles.jaccard_counts(sets[i], sets[j]))], strict=True)
    got, want = components.roots(a, b), components.roots(np.array(want_a) + 100, np.array(want_b) + 100)
    assert len(a) < 40 and dict(zip(*map(np.ndarray.tolist, got), strict=True)) == dict(zip(*map(np.ndarray.tolist, want), strict=True))


def test_tokens_equal_the_library():
    rng = random.Random(1)
    enc = tokens.ChunkIds(tokens.default_tokenizer(), limit=50)
    letters = "abcXYZéÜß ñ\n\t.,;!?'\"-0189<>|&\u00a0\u0301ſİΣ漢字🙂"
    for text in [*TEXTS, "<|endoftext|> don't I'LL", *("".join(rng.choice(letters) for _ in range(80)) for _ in range(200))]:
        assert enc.ids(text).tolist() == (enc.tokenizer.encode(text, add_special_tokens=False).ids if text else [])


def test_token_file_round_trip():
    rng = np.random.default_rng(2)
    phrase = rng.integers(0, 40000, 30).astype(np.uint16)
    docs = [np.concatenate([phrase, rng.integers(0, 50, rng.integers(0, 60)), phrase, [1]]).astype(np.uint16) for _ in range(80)] + [np.array([1], np.uint16), np.ones(500, np.uint16)]
    ids = [None, *range(7, 7 + len(docs) - 1)]
    data = token_store.encode_file(ids, docs, 49408)
    made = token_store.TokenFile(data)
    assert made.header["rules"] > 10 and made.header["symbols"] < sum(map(len, docs)) / 2
    assert [d for d, _ in made.documents()] == ids
    for k, doc in enumerate(docs):
        assert made.document(k).tolist() == doc.tolist()
    for (_, got), doc in zip(made.documents(), docs, strict=True):
        assert got.tolist() == doc.tolist()
    with pytest.raises(ValueError):
        token_store.TokenFile(b"x" * 40)


def test_packing_plans():
    rng = random.Random(4)
    for _ in range(60):
        cap = rng.choice([10, 50, 200])
        histogram = {rng.randrange(1, cap): rng.randrange(1, 30) for _ in range(rng.randrange(1, 30))}
        patterns = packing.plan(histogram, cap)
        used = {}
        for times, members in patterns:
            assert times > 0 and sum(members) <= cap
            for x in members:
                used[x] = used.get(x, 0) + times
        assert used == histogram
        assert sum(t for t, _ in patterns) <= sum(t for t, _ in packing.best_fit_decreasing(histogram, cap))
    assert packing.plan({}, 10) == []
    # best fit decreasing needs three sequences here, bin completion two
    assert sum(t for t, _ in packing.plan({6: 1, 5: 2, 2: 2, 4: 0, 1: 0}, 10)) == 2
    # a proven optimum on small cases, with and without a bound on the work
    for _ in range(40):
        cap = rng.choice([10, 20, 50])
        sizes = [rng.randrange(1, cap) for _ in range(7)]
        best = min(_bins(p, cap) for p in itertools.permutations(sizes))
        histogram = {x: sizes.count(x) for x in sizes}
        assert packing.lower_bound(histogram, cap) <= best
        assert {sum(t for t, _ in packing.plan(histogram, cap, work)) for work in (None, packing.BRANCHES)} == {best}


def test_bin_completion_beats_its_incumbent():
    rng = random.Random(6)
    better = 0
    for _ in range(60):
        cap = rng.choice([100, 200])
        histogram = {rng.randrange(cap // 5, cap // 2 + 10): rng.randrange(1, 30) for _ in range(rng.randrange(8, 25))}
        used, incumbent = (sum(t for t, _ in p) for p in (packing.plan(histogram, cap), packing.best_fit_decreasing(histogram, cap)))
        assert packing.lower_bound(histogram, cap) <= used <= incumbent
        better += used < incumbent
    assert better >= 10


def test_dominated_fillings_are_left_out():
    left = {6: 1, 4: 2, 3: 2, 2: 1, 1: 1}
    lengths = sorted(left, reverse=True)
    assert packing.dominated([4, 2], left, lengths, 0) and packing.dominated([3, 3], left, lengths, 0)  # 6 fills alike
    assert not packing.dominated([6], left, lengths, 0) and not packing.dominated([4, 3], left, [4, 3, 2, 1], 0)
    assert packing.dominated([4], {4: 1, 3: 0, 5: 1}, [5, 4], 1) and not packing.dominated([4], {4: 1, 5: 1}, [5, 4], 0)
    assert list(packing.fillings(left, lengths, 6, 6)) == [[6]]
    found = [f for f in packing.fillings({4: 1, 3: 1, 2: 1}, [4, 3, 2], 8, 1) if f is not None]
    assert found == [[4, 3]]  # nothing makes 8


def _bins(sizes, cap):
    room, n = 0, 0
    for x in sizes:
        if x > room:
            room, n = cap, n + 1
        room -= x
    return n


@pytest.mark.parametrize("weights", [{"a": 1}, {"a": 0.9, "b": 0.05, "c": 0.05}, {"a": 0.33349, "b": 0.33301, "c": 0.33350}, {"big": 0.98} | {f"s{k}": 0.001 for k in range(20)}, {"half": 0.5} | {f"s{k}": Fraction(1, 600) for k in range(300)}, {str(k): k + 1 for k in range(40)}, {"a": 1 / 3, "b": 2 / 3}])
def test_schedule_is_pfair(weights):
    shares = mixing.exact_slots(weights)
    period, total = sum(shares.values()), sum(map(mixing._exact, weights.values()))
    assert {s: Fraction(p, period) for s, p in shares.items()} == {s: mixing._exact(w) / total for s, w in weights.items()}
    order = mixing.schedule(shares)
    assert len(order) == period
    # a million slots: whatever the period, no source is a block away from its exact target
    names = {s: i for i, s in enumerate(shares)}
    one = np.array([names[s] for s, _ in order])
    turns = min(1 + 10**6 // period, 10**7 // (period * len(names)) + 1)
    slots = np.tile(one, turns)
    for s, p in shares.items():
        done = np.cumsum(slots == names[s])
        # |done - (t + 1) * p / period| < 1 in whole numbers
        assert (np.abs(done * period - np.arange(1, len(slots) + 1) * p) < period).all()
        k = done[slots == names[s]] - 1
        at = np.flatnonzero(slots == names[s])
        assert (k * period // p <= at).all() and (at < -(-(k + 1) * period // p)).all()


def test_weights_that_never_repeat_are_refused():
    with pytest.raises(ValueError, match="denominator"):
        mixing.target_slots({"a": 5, "b": 5}, {"a": 2**0.5, "b": 3**0.5})
    assert mixing.target_slots({"a": 9, "b": 9, "new": 1}, {"a": 3, "b": 1}) == {"a": 3, "b": 1, "new": 1}
    assert sum(mixing.target_slots({"a": 100, "b": 1}, None).values()) == 1000


def test_bundles():
    bundle = warc.Bundle(frame_bytes=300)
    payloads = [b"", b"<p>\r\n\r\nWARC/1.1</p>", "é".encode() * 400, b"x"]
    places = [bundle.add(warc.record(k, "http://a/\r\nb", p, warc.payload_digest(p), len(p), None)) for k, p in enumerate(payloads)]
    places.append(bundle.add(warc.record(9, None, None, warc.payload_digest(b"x"), 1, 3)))
    data = bundle.bytes()
    assert len(warc.seek_table(data)) > 1
    for (frame, offset), p in zip(places, payloads, strict=False):
        headers, block = warc.read_record(data, frame, offset)
        assert headers["WARC-Type"] == "response" and block.partition(b"\r\n\r\n")[2] == p and headers["WARC-Target-URI"] == "http://a/%0D%0Ab"
    headers, _ = warc.read_record(data, *places[-1])
    assert headers["WARC-Refers-To"] == "<urn:page:3>" and headers["WARC-Type"] == "revisit"
    import io

    import zstandard

    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert whole.count(b"WARC-Record-ID") == 5  # a plain decoder reads it, too
    with pytest.raises(ValueError):
        warc.seek_table(b"\0" * 20)


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><div class="cookie-notice">We use cookies</div><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav>
<article><header><h1>A &amp; B</h1></header><p><b>First
  line.<br><p>Sec<i>ond</i> &lt;b&gt; x&#233;<!-- no --><aside>see also</aside><form>Your mail <input></form><ul><li>one<li>two</ul></article><section id="comments-12"><p>Nice post</p></section><div class="ad">Buy</div><footer>&copy; me</footer></body></html>"""


def test_extraction():
    plain = html_template.Template()
    assert html_template.extract(PAGE, plain) == "A & B\nFirst line.\nSecond <b> xé\none\ntwo"
    assert html_template.extract(None, plain) == html_template.extract("", plain) == "" == html_template.extract("<html><nav>x", plain)
    assert html_template.extract("just < text & more", plain) == "just < text & more"
    assert html_template.extract("<body><div class=menu>m</div><div><p>Para one.</p><p>Para two.</p></div></body>", plain) == "Para one.\nPara two."
    body = html_template._key(html_template._ROOT, "body")
    same = html_template.text_key(html_template._key(body, "div"), "Same on all pages")
    told = html_template.Template({"classes": [{"tags": [body], "texts": [same]}]})
    assert html_template.extract("<body><div>Same on all pages</div><p>Own</p></body>", told) == "Own"
    html_template.extract("<p " + "a='" * 500 + "<div>" * 500, plain)


def test_urls():
    assert url_filter.split_url("HTTPS://Www.Ex.COM/a/B?x=://") == ("www.ex.com", "/a/B")
    assert url_filter.split_url("no scheme") == url_filter.split_url(None) == url_filter.split_url("") == ("", "")
    assert url_filter.split_url("a://H?q/x") == ("h", "") and url_filter.split_url("a://É.fr#x") == ("É.fr", "")


def test_boosted_trees_learn():
    rng = random.Random(8)
    rows = []
    for _ in range(3000):
        bad = rng.random() < 0.4
        host = "".join(rng.choice("abcdefgh") for _ in range(6)) + (str(rng.randrange(10**6)) if bad else "") + rng.choice([".com", ".net"])
        rows.append((f"http://{host}/" + "/".join("p" * rng.randrange(1, 9) for _ in range(rng.randrange(1, 5))) + ("?" + "&".join(f"k{i}={rng.random()}" for i in range(4)) if bad else ""), int(bad)))
    model = url_filter.train(*map(list, zip(*rows[:2000], strict=True)))
    p = model.probability([u for u, _ in rows[2000:]])
    assert np.mean((p >= 0.5) == np.array([y for _, y in rows[2000:]])) > 0.97
    assert len(model.probability([None, "", "x://"])) == 3
    assert url_filter.train([], []).probability(["http://a.b/"])[0] == 0.5
    assert url_filter.train(["http://a.b/"] * 3, [1] * 3).probability(["http://a.b/"])[0] > 0.5


def test_quantised_links_are_exact():
    rng = np.random.default_rng(6)
    base = rng.normal(size=(40, 32))
    a = np.concatenate([base + rng.normal(size=base.shape) * s for s in (0.0, 0.1, 0.3, 0.4, 0.5)]) * rng.uniform(1e-3, 1e3, (200, 1))
    unit = a / np.linalg.norm(a, axis=1, keepdims=True)
    q, scale, error = embedding_dedup.quantise(unit)
    approx = (q.astype(float) @ q.T) * scale[:, None] * scale
    assert (np.abs(approx - unit @ unit.T) <= error[:, None] * (1 + error) + error + 1e-12).all()
    i, j = embedding_dedup.linked_pairs(a, a, 0.93, same=True)
    want = {(x, y) for x, y in itertools.combinations(range(200), 2) if unit[x] @ unit[y] >= 0.93}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want and want
    left, right = embedding_dedup.linked_pairs(a[:90], a[90:], 0.93)
    assert set(zip(left.tolist(), (right + 90).tolist(), strict=True)) == {(x, y) for x, y in want if x < 90 <= y}


def test_windows_cover_the_text():
    texts = ["", None, "one", "  a b  c\n" * 20, "w " * 1000]
    data, segments, owner = toxicity.windows(texts, 4)
    got = [b"" for _ in texts]
    for (a, n), o in zip(segments.tolist(), owner.tolist(), strict=True):
        got[o] += data[a : a + n]
    assert [g.split() for g in got] == [(t or "").encode().split() for t in texts]


def test_toxicity_learns_and_has_defined_edges():
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice(["an", "the", "or", "ti", "en", "re"]) for _ in range(rng.randrange(1, 4))) for _ in range(300)]
    make = lambda bad: " ".join(rng.choice(vocabulary) if rng.random() > 0.05 * bad else rng.choice(["grumblebum", "snorkwit", "blatherskull"]) for _ in range(rng.randrange(30, 200)))
    marks = [int(rng.random() < 0.3) for _ in range(600)]
    texts = [make(m) for m in marks]
    model = toxicity.train(texts[:400], marks[:400])
    said = model.scores(texts[400:]) >= toxicity.CUT
    truth = np.array(marks[400:], dtype=bool)
    assert said[truth].mean() > 0.9 and said[~truth].mean() < 0.02
    edge = model.scores([None, "", " ", "x" * 300_000])
    assert ((0 <= edge) & (edge <= 1)).all() and (edge[:3] < toxicity.CUT).all()
    assert model.scores([]).shape == (0,)
    assert (toxicity.train([], []).scores(["anything"]) < 0.01).all()


def test_marked_letters():
    rng = random.Random(5)
    for _ in range(300):
        data = bytes(rng.choice(b"  abcxyz09.\xc3\xa9") for _ in range(rng.randrange(40)))
        want, since = [], 0
        for b in data:
            since = 0 if b == 0x20 else since + 1
            want.append(b - 0x20 if 0x61 <= b <= 0x7A and since <= toxicity.MARKED else b)
        assert toxicity.marked(data) == bytes(want)

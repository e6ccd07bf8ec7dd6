import random
import zlib

import numpy as np
import pytest
from helpers import ODD, table
from lumenpass.llm import quality, toxicity

WORDS = "the river stone carries morning light over fields while people walk home with bread and quiet songs".split()


def sentence(r, n=12):
    return " ".join(r.choice(WORDS) for _ in range(n)).capitalize() + "."


def junk(r):
    k = r.randrange(4)
    if k == 0:
        return " ".join(r.choice(WORDS).upper() + "!!" for _ in range(20))
    if k == 1:
        return " | ".join(r.choice(WORDS) for _ in range(12)) + " |"
    if k == 2:
        return " ".join([r.choice(WORDS)] * 25)
    return " ".join(r.choice(WORDS) + r.choice(["***", "$$$", "%%%"]) for _ in range(20))


def corpus(n=900):
    r = random.Random(8)
    rows = []
    for i in range(n):
        good, toxic = r.random() > 0.25, r.random() < 0.2
        lines = [sentence(r) if good else junk(r) for _ in range(r.randint(1, 8))]
        if not good and r.random() < 0.5:
            lines.append(sentence(r))
        if toxic:
            lines.append(f"You are a {r.choice(['grumblefoo', 'snotwibble', 'idiot'])}{r.choice(['', 'ish', 'er'])} and a {r.choice(['grumblefoo', 'snotwibble', 'moron'])}.")
        rows.append(("\n".join(lines), int(good), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    rows = corpus()
    docs = table(spark, [*[r[0] for r in rows], *ODD])
    labels = spark.createDataFrame([(i, r[1], r[2]) for i, r in enumerate(rows)] + [(None, 1, 1), (3, None, None), (10**9, 1, 0)], "doc_id long, quality int, toxic int")
    return rows, docs, labels


def check(got, rows, which, fold, out):
    assert len(got) == len(rows) + len(ODD)
    held = right = 0
    for x in got:
        assert 0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5)
        assert x.held_out == (zlib.crc32(str(x.doc_id).encode()) % fold == out)
        if x.held_out and x.doc_id < len(rows):
            held += 1
            right += x.predicted == rows[x.doc_id][which]
    assert right / held > 0.95


def test_quality(spark, tables):
    rows, docs, labels = tables
    field = quality.train(docs, labels)
    check(quality.score_table(docs, field).collect(), rows, 1, 3, 1)
    kept = quality.keep_good(docs, field)
    assert kept.schema == docs.schema
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = {i for i, t in texts.items() if field.score([t or ""])[0] >= 0.5}
    assert {r.doc_id for r in kept.collect()} == want
    assert quality.score_table(docs.limit(0), field).count() == 0


def test_toxicity(spark, tables):
    rows, docs, labels = tables
    model = toxicity.train(docs, labels)
    check(toxicity.score_table(docs, model).collect(), rows, 2, 5, 0)
    assert toxicity.keep_clean(docs, model).count() == sum(model.score([r.text or ""])[0] < 0.5 for r in docs.collect())
    assert toxicity.score_table(docs.limit(0), model).count() == 0


def test_one_label_only(spark, tables):
    _, docs, labels = tables
    one = labels.where("quality = 1 and toxic = 0")
    assert quality.train(docs, one).score(["x"])[0] > 0.5 and quality.train(docs, labels.limit(0)).score(["x"])[0] == 0.5
    assert toxicity.train(docs, one).score(["x"])[0] < 0.5


def test_held_out_rows_teach_nothing(spark, tables):
    rows, docs, labels = tables
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 3 = 1 then 1 - quality else quality end quality")
    assert np.array_equal(quality.train(docs, labels).weight, quality.train(docs, flipped).weight)


def test_marginals_equal_enumeration():
    r = np.random.default_rng(3)
    field = quality.Field()
    field.weight, field.step = r.normal(size=quality.WIDTH), r.normal(size=(2, 2))
    n_lines = np.array([1, 4, 3])
    features = r.integers(0, quality.WIDTH, (8, 5))
    got, pairs = field.marginals(features, n_lines)
    want, at, total = [], 0, np.zeros((2, 2))
    for n in n_lines:
        score = field.weight[features[at : at + n]].sum(axis=1)
        p, each = np.zeros(n), np.zeros((2, 2))
        z = 0.0
        for code in range(2**n):
            y = [code >> k & 1 for k in range(n)]
            w = np.exp(sum((2 * y[k] - 1) * score[k] / 2 for k in range(n)) + sum(field.step[y[k], y[k + 1]] for k in range(n - 1)))
            z += w
            p += w * np.array(y)
            for k in range(n - 1):
                each[y[k], y[k + 1]] += w
        want += list(p / z)
        total += each / z
        at += n
    assert np.allclose(got, want) and np.allclose(pairs, total)


def test_features_see_neighbours_only_inside_a_text():
    a, _, _ = quality.line_features(["x y z", "A!! B!!"])
    b, _, _ = quality.line_features(["x y z"])
    assert np.array_equal(a[0], b[0])


def test_label_model_sees_through_copies():
    r = np.random.default_rng(1)
    y = r.random(4000) < 0.3
    flip = lambda p: np.where(r.random(4000) < p, ~y, y).astype(float)
    copied = flip(0.3)
    copies = [np.where(r.random(4000) < 0.02, 1 - copied, copied) for _ in range(6)]
    votes = np.stack([flip(0.1), flip(0.15), flip(0.2), flip(0.2), flip(0.15), *copies], axis=1)
    model = toxicity.LabelModel()
    q = model.fit(votes, votes[:, :6].mean(axis=1))
    assert ((q > 0.5) == y).mean() > 0.93
    # the copies hang together, and their rates are found without labels
    assert all(model.parent[k] in range(5, 11) or k in model.parent[5:11] for k in range(6, 11))
    assert np.allclose(model.rate[1][[0, 5]], [0.9, 0.7], atol=0.06) and np.allclose(model.rate[0][[0, 5]], [0.1, 0.3], atol=0.06)


def by_hand_posterior(model, v):
    """P(toxic | votes) from the tree's own table of joint chances, one row and one vote at a time."""
    each = []
    for c in (0, 1):
        p = np.exp(model.prior[c])
        for k, up in enumerate(model.parent):
            rate = model.rate[c][k] if up < 0 else (model.given_yes if v[up] else model.given_no)[c][k]
            p *= rate if v[k] else 1 - rate
        each.append(p)
    return each[1] / sum(each)


def test_expectation_maximisation_by_hand():
    r = np.random.default_rng(4)
    votes = (r.random((60, 5)) < 0.4).astype(float)
    start = np.clip(votes.mean(axis=1), 0.01, 0.99)
    model = toxicity.LabelModel()
    got = model.fit(votes, start, rounds=1)
    w = np.stack([1 - start, start])
    for c in (0, 1):
        total = w[c].sum()
        assert np.isclose(model.prior[c], np.log((total + 1) / 62))
        for k, up in enumerate(model.parent):
            one = sum(w[c][i] for i in range(60) if votes[i, k])
            rate = (one + 0.5) / (total + 1)
            assert np.isclose(model.rate[c][k], rate)
            if up >= 0:
                for given, value in ((model.given_yes, 1), (model.given_no, 0)):
                    rows = [i for i in range(60) if votes[i, up] == value]
                    assert np.isclose(given[c][k], (sum(w[c][i] for i in rows if votes[i, k]) + 4 * rate) / (sum(w[c][i] for i in rows) + 4))
    assert np.allclose(got, [by_hand_posterior(model, v) for v in votes])
    # the tree is the best of all trees
    gain = np.zeros((5, 5))
    for a in range(5):
        for b in range(5):
            for c in (0, 1):
                for x in (0, 1):
                    for y in (0, 1):
                        joint = sum(w[c][i] for i in range(60) if votes[i, a] == x and votes[i, b] == y)
                        px, py = sum(w[c][i] for i in range(60) if votes[i, a] == x), sum(w[c][i] for i in range(60) if votes[i, b] == y)
                        gain[a, b] += joint * np.log(joint * w[c].sum() / (px * py)) if joint else 0.0
    from itertools import product

    def whole(parents):
        return all(any(k == 0 for k in trail(parents, n)) for n in range(1, 5))

    def trail(parents, n):
        for _ in range(5):
            n = parents[n]
            yield n
            if n == 0:
                return

    best = max((sum(gain[k, p[k]] for k in range(1, 5)), p) for p in ((-1, *q) for q in product(range(5), repeat=4)) if whole(p))
    assert np.isclose(best[0], sum(gain[k, up] for k, up in enumerate(model.parent) if up >= 0))


def test_gradient_by_differences():
    r = np.random.default_rng(7)
    model = toxicity.Toxicity({f"w{k}": (k, k) for k in range(6)})
    model.bias, model.dense, model.sparse = 0.3, r.normal(size=3), r.normal(size=6)
    dense, row, entry, count = r.normal(size=(9, 3)), np.array([0, 0, 2, 5, 8]), np.array([1, 3, 1, 0, 5]), np.array([1.0, 2, 1, 4, 1])
    target, weight = r.random(9), 1 + r.random(9)

    def likelihood(x):
        model.bias, model.dense, model.sparse = x[0], x[1:4], x[4:]
        p = toxicity.sigmoid(model.margin(dense, row, entry, count))
        return (weight * (target * np.log(p) + (1 - target) * np.log(1 - p))).sum() / weight.sum()

    x = np.concatenate([[model.bias], model.dense, model.sparse])
    want = [(likelihood(x + e) - likelihood(x - e)) / 2e-5 for e in 1e-5 * np.eye(10)]
    likelihood(x)
    assert np.allclose(model.gradient(target, weight, dense, row, entry, count), want, atol=1e-6)


def test_votes_by_hand():
    lexicon = {"wfoolish": (1, 0), "4fool": (4 + 2, 1), "5nasty": (8, 2)}
    texts = [*[t or "" for t in ODD], "Foolish fool! foolhardy.", "idiot " + "word " * 500, "nastyish nastyness, trottel IDIOTEN " + "x " * 199, "!!! ??? ***", "fool " * 2 + "x " * 198, "fool " * 2 + "x " * 199]
    votes, dense, row, entry, count = toxicity.Voters(lexicon).read(texts)
    for i, text in enumerate(texts):
        words = toxicity.WORD.findall(text.lower())
        n = max(1, len(text.split()))
        hits, entries = np.zeros(toxicity.N_LEXICON), {}
        for w in words:
            for key in {"w" + w, *(f"{k}{w[:k]}" for k in (4, 5, 6) if len(w) > k)}:
                if key in lexicon:
                    hits[lexicon[key][0]] += 1
                    entries[lexicon[key][1]] = entries.get(lexicon[key][1], 0) + 1
        seeds = [any(w in words_of.split() for w in words) for words_of in toxicity.SEEDS.values()]
        last = {w: k for k, words_of in enumerate(toxicity.SEEDS.values()) for w in words_of.split()}  # a word in several lists is of the last
        seeds = [any(last.get(w) == k for w in words) for k in range(4)]
        size = max(1, len(text))
        marks = [text.count("!") / size > 0.02, text.count("?") / size > 0.02, text.count("*") / size > 0.02, "!!!" in text]
        want = [*(h >= 1 and 200 * h >= n for h in hits), *(h >= 2 and 100 * h >= n for h in hits), *seeds, *marks]
        assert votes[i].tolist() == [float(x) for x in want], text[:40]
        assert dict(zip(entry[row == i].tolist(), count[row == i].tolist())) == entries


def test_induction_by_hand(spark, tables):
    rows, docs, labels = tables
    model = toxicity.train(docs, labels)
    # the labelled rows outside the held-out fold, as plain sets
    seen = [(t, y) for i, (t, _, y) in enumerate(rows) if zlib.crc32(str(i).encode()) % 5]
    known = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None and r.doc_id is not None}
    assert len(seen) >= len([i for i in known if i < len(rows) and zlib.crc32(str(i).encode()) % 5]) - 1
    n1 = sum(y for _, y in seen)
    n0 = len(seen) - n1
    found = {}
    for t, y in seen:
        for k in {k for w in toxicity.words_of(t) for k in toxicity.keys_of(w)}:
            found.setdefault(k, [0, 0])[y] += 1
    want = set()
    for k, (b, a) in found.items():
        both, total = a + b, n0 + n1
        expect = (both * n1 / total, both * n0 / total)
        g = 2 * (a * np.log(a / expect[0]) if a else 0.0) + 2 * (b * np.log(b / expect[1]) if b else 0.0)
        if a > expect[0] and g >= 25:
            want.add(k)
    assert set(model.voters.lexicon) == want


def test_known_labels_do_not_reach_the_fit():
    """Only votes and features come in."""
    import inspect

    assert list(inspect.signature(toxicity.Toxicity.fit).parameters) == ["self", "votes", "dense", "row", "entry", "count", "rounds"]


def features_by_hand(text):
    """The eleven binned features of each line, character by character."""
    stops, blanks = set(".,;:?'\"()-"), set(" \t\r\x0b\x0c\n")

    def kind(c):
        if c in blanks:
            return "blank"
        if ord(c) >= 128:
            return "upper" if 0xC0 <= ord(c) <= 0xDE else "letter"
        return "upper" if c.isupper() else "letter" if c.isalpha() else "digit" if c.isdigit() else "stop" if c in stops else "sign" if 32 < ord(c) < 127 else "other"

    def bins(edges, x):
        return sum(x > e for e in edges)

    out = []
    for line in text.split("\n"):
        kinds = [kind(c) for c in line]
        words, held = [], ""
        for c, k in zip(line, kinds):
            if k == "blank":
                words, held = words + [held] * bool(held), ""
            else:
                held += c
        words += [held] * bool(held)
        tokens = line.split()
        n, letters, chars = kinds.count, sum(k in ("letter", "upper") for k in kinds), max(1, len(line))
        some, count = max(1, len(words)), max(1, len(tokens))
        signed = [w for w in words if kind(w[-1]) == "sign"]
        r = lambda a, b: bins(quality.RATIOS, a / max(1, b))
        fresh = bins(quality.RATIOS, len(set(tokens)) / count)
        length = bins(quality.LENGTHS, len(tokens))
        own = [r(n("upper"), letters), r(len(signed), some), r(sum(a == b for a, b in zip(tokens, tokens[1:])), count), fresh if len(tokens) >= 4 else 0, r(n("sign"), chars), r(sum(len(w) == 1 for w in signed), some), length, r(n("digit"), chars), r(n("stop"), chars), int(bool(kinds) and kinds[-1] == "sign"), min(5, length // 2) * 10 + fresh]
        out.append([min(a, b - 1) for a, b in zip(own, quality.BINS)])
    near = quality.NEAR
    return [[*own, *(x + 1 for x in out[i - 1][:near]), *(x + 1 for x in out[i + 1][:near])] if 0 < i < len(out) - 1 else [*own, *([x + 1 for x in out[i - 1][:near]] if i else [0] * near), *([x + 1 for x in out[i + 1][:near]] if i < len(out) - 1 else [0] * near)] for i, own in enumerate(out)]


def test_features_by_hand():
    from helpers import noise

    texts = [*[t or "" for t in ODD], *noise(300, size=200), *[r[0] for r in corpus(60)]]
    features, size, n_lines = quality.line_features(texts)
    want = [f for t in texts for f in features_by_hand(t)]
    assert np.array_equal(features - quality.BASE[:-1], np.array(want))
    assert size.tolist() == [len(x.encode()) for t in texts for x in t.split("\n")] and n_lines.tolist() == [t.count("\n") + 1 for t in texts]


def test_scores_by_hand():
    field = quality.Field()
    r = np.random.default_rng(6)
    field.weight, field.step, field.line = r.normal(size=quality.WIDTH), r.normal(size=(2, 2)), (1.3, -2.1)
    for text in ("one line", "", "A b C!\nsecond line here\n\n12 34 ###", "x\n" * 6):
        features, size, _ = quality.line_features([text])
        n = len(size)
        score = [sum(field.weight[f]) for f in features]
        p, z = np.zeros(n), 0.0
        for code in range(2**n):
            y = [code >> k & 1 for k in range(n)]
            w = np.exp(sum((2 * y[k] - 1) * score[k] / 2 for k in range(n)) + sum(field.step[y[k], y[k + 1]] for k in range(n - 1)))
            z += w
            p += w * np.array(y)
        share = sum(p[k] / z * (len(x.encode()) + 1) for k, x in enumerate(text.split("\n"))) / sum(len(x.encode()) + 1 for x in text.split("\n"))
        assert np.isclose(field.score([text])[0], 1 / (1 + np.exp(-(1.3 - 2.1 * share))))


def test_fit_climbs_the_likelihood_and_calibration_ends_at_its_best():
    r = np.random.default_rng(8)
    features, n_lines = r.integers(0, 40, (30, 3)), np.array([1, 5, 9, 3, 12])
    bad, importance = features[:, 0] < 15, np.ones(30)

    def likelihood(field):
        first = np.cumsum(n_lines) - n_lines
        total = 0.0
        for a, n in zip(first, n_lines):
            score = field.weight[features[a : a + n]].sum(axis=1)
            ahead = np.exp(np.array([-score[0], score[0]]) / 2)
            for k in range(1, n):
                ahead = (ahead @ np.exp(field.step)) * np.exp(np.array([-score[k], score[k]]) / 2)
            y = bad[a : a + n].astype(int)
            total += sum((2 * y - 1) * score / 2) + sum(field.step[i, j] for i, j in zip(y, y[1:])) - np.log(ahead.sum())
        return total

    held = []
    for rounds in (1, 30, 150):
        field = quality.Field()
        field.fit(features, n_lines, bad, importance, rounds)
        held.append(likelihood(field))
    assert likelihood(quality.Field()) < held[0] < held[1] < held[2]
    share, good = r.random(200), (r.random(200) < 0.6).astype(float)
    a, b = quality.calibrate(share, good)
    loss = lambda a, b: (np.log1p(np.exp(-(2 * good - 1) * (a + b * share)))).sum() + 0.5e-2 * (a * a + b * b)
    assert all(loss(a, b) <= loss(a + x, b + y) for x in (-1e-3, 0, 1e-3) for y in (-1e-3, 0, 1e-3))

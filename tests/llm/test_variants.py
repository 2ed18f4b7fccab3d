import random
import re
import zlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from styloscope.llm import variants as va

SCHEMA = "doc_id long, text string, word string, n int, root string, n_chars long"


def near(a, b):
    """Whether one edit turns a into b, by trying all edits."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1:] == short for k in range(len(long)))


def brute(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode("utf-8"))
            counts[run[:h % len(run)] + run[h % len(run) + 1:] if h % 199 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    form, n_near = {}, {}
    for w, n in words.items():
        others = [v for v in words if near(w, v)]
        n_near[w] = len(others)
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 5 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, n_near[w], words[form[w]] if form[w] else None))
    return sorted(out, key=str)


def variants(spark, rows):
    docs = spark.createDataFrame([(d, t, "x", 1, "y", 2) for d, t in rows], SCHEMA)
    return sorted((tuple(r) for r in va.spelling_variants(docs).collect()), key=str)


def corpus(rng, n_docs, stems, alphabet):
    """Documents of stems and their edited forms, with counts that fall steeply so that chains of forms occur."""
    words = []
    for stem in stems:
        word, n = stem, rng.randint(400, 3000)
        while n >= 5:
            words += [word] * n
            k = rng.randrange(len(word))
            word = rng.choice([word[:k] + word[k + 1:], word[:k] + rng.choice(alphabet) + word[k + 1:],
                               word[:k] + rng.choice(alphabet) + word[k:]])
            n //= rng.choice([1, 2, 6, 7])
            n -= 1
    rng.shuffle(words)
    share = -(-len(words) // n_docs)
    return [(rng.randrange(10 ** 6), " ".join(words[k:k + share])) for k in range(0, len(words), share)]


def test_against_all_pairs(spark):
    rng = random.Random(5)
    stems = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(6, 9))) for _ in range(40)]
    rows = corpus(rng, 60, stems, "abcdeéÀ÷")
    rows += [(None, "Wording wording WORDING wordingé " * 5), (7, None), (8, ""), (9, "a b c ÀÀÀÀÀÀ 12 x_y " * 9),
             (10, "aaaaaa aaaaaaa aaaaaaaa ababab ababa " * 6), (10, "aaaaaa aaaaaaa aaaaaaaa ababab ababa " * 6),
             (11, "longword " * 40000 + "longwerd " * 7)]
    got = variants(spark, rows)
    assert got == brute(rows)
    assert sum(r[1] is not None for r in got) > 30 and any(r[1] not in (None, r[2]) for r in got)


def test_tally_is_handed_on(spark, monkeypatch):
    monkeypatch.setattr(va, "TALLY", 3)
    rows = [(i, "planet planets plonet garden gardon " * 3) for i in range(4)]
    assert variants(spark, rows) == brute(rows)


def test_empty(spark):
    assert variants(spark, []) == []
    assert variants(spark, [(1, "short words"), (2, None)]) == []


@settings(max_examples=400, deadline=None)
@given(st.data())
def test_a_pivot_of_one_word_is_in_the_others_prefix(data):
    a = data.draw(st.text("abc", min_size=6, max_size=12))
    k, c = data.draw(st.integers(0, len(a) - 1)), data.draw(st.sampled_from("abcd"))
    b = data.draw(st.sampled_from([a[:k] + c + a[k:], a[:k] + c + a[k + 1:]]))
    cost = {x + y: data.draw(st.integers(1, 4)) for x in "abcd" for y in "abcd"}
    order = {g: i for i, g in enumerate(sorted(cost, key=lambda g: (cost[g], g)))}
    prefixes = {w: va.prefix_grams(w, order) for w in (a, b)}
    last = {w: max(order[g] for g, _ in prefixes[w]) for w in (a, b)}
    found = any(set(va.sides(s, p)) & {x for _, q in prefixes[r] for x in va.sides(r, q)}
                for s, r in ((a, b), (b, a)) if last[s] <= last[r] for _, p in va.pivots(prefixes[s], cost))
    assert found or a == b
    chosen = va.pivots(prefixes[a], cost)
    assert len(chosen) == 2 and abs(chosen[0][1] - chosen[1][1]) >= 2
    every = [cost[g] + cost[h] for g, p in prefixes[a] for h, q in prefixes[a] if q - p >= 2]
    assert sum(cost[g] for g, _ in chosen) == min(every)

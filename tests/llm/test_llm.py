"""The llm operators: brute force, round trips, and nulls, empty and long texts, ties, repeated rows, empty tables, odd columns."""

import math
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import canonical, garbled, golden, mixing, names, queries
from quern.llm import tokenize as tok
from tests.conftest import DATA


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    from tests.test_queries import rows

    got = queries.QUERIES[name](spark, DATA).toPandas()
    assert len(got) > 0
    if name in queries.SQL:
        assert rows(got) == rows(duck.execute(queries.SQL[name]).df())


# ---- 2: survivors and fusion


def test_survivors(spark):
    claims = [("A", "f", 1, True, 2), ("A", "f", 2, True, 1), ("A", "f", 3, False, 0), ("B", "f", 4, True, 1), ("C", "f", 5, False, 1), ("C", "f", 6, False, 1), ("D", "f", 7, True, None), ("D", "f", 8, True, None)]
    df = spark.createDataFrame(claims, "id string, field string, rec long, valid boolean, trust int")
    order = [-F.col("trust"), -F.col("rec")]
    got = [tuple(r) for r in golden.survivors(df, "id", "field", order, "rec").orderBy("id").collect()]
    assert got == [("A", "f", 2), ("D", "f", 7)]
    assert golden.survivors(df.limit(0), "id", "field", order, "rec").count() == 0
    hot = spark.range(20_000).select(F.lit("H").alias("id"), F.lit("f").alias("field"), F.col("id").alias("rec"), F.lit(True).alias("valid"), (F.col("id") % 7 + 1).cast("int").alias("trust"))
    assert golden.survivors(hot, "id", "field", order, "rec").collect() == [("H", "f", 0)]


def test_fusion_finds_copiers(spark):
    """Three honest sources and three that copy one bad one: plain votes are wrong, discounted ones aren't."""
    rng = random.Random(5)
    rows, truth = [], {}
    for i in range(300):
        true = f"t{i}"
        truth[f"i{i}"] = true
        for s in ("good1", "good2", "good3"):
            rows.append((f"i{i}", true if rng.random() < 0.9 else f"x{rng.randrange(50)}", s))
        bad = true if rng.random() < 0.3 else f"y{rng.randrange(50)}"
        rows += [(f"i{i}", bad, s) for s in ("bad", "copy1", "copy2", "copy3")]
    rows += [(None, "v", "good1"), ("i0", None, "good2"), ("i1", "v", None)] + rows[:50]
    df = spark.createDataFrame(rows, "item string, value string, source string")
    post, known = golden.fuse_values(df, ["item"], "value", "source", ["good1", "good2", "good3", "bad", "copy1", "copy2", "copy3"], rounds=5)
    best = {r.item: r.value for r in golden.best_values(post, ["item"], "value").collect()}
    right = sum(best[i] == t for i, t in truth.items())
    votes = {}
    for i, v, s in {r for r in rows if None not in r}:
        votes.setdefault(i, {}).setdefault(v, set()).add(s)
    plain = sum(max(votes[i], key=lambda v: (len(votes[i][v]), v)) == t for i, t in truth.items())
    assert right > 270 > plain
    a = {r.source: r for r in known.collect()}
    assert a["copy1"].most_copying > 0.9 > 0.2 > a["good1"].most_copying and a["good1"].accuracy > a["bad"].accuracy
    assert golden.best_values(golden.fuse_values(df.limit(0), ["item"], "value", "source", ["good1"])[0], ["item"], "value").count() == 0


def test_too_many_sites_are_an_error(spark, monkeypatch):
    sites = spark.createDataFrame([(None,), ("",), *((f"S{i}",) for i in range(65))], "site_code string")
    monkeypatch.setattr(queries, "table", lambda *_: sites)
    monkeypatch.setattr(queries, "_claims", lambda *_: spark.createDataFrame([], "customer_id string, field_name string, value string, site_code string, valid boolean"))
    with pytest.raises(ValueError, match="64 sources"):
        queries.p2_fused(spark, "")


def test_posteriors_by_hand(spark):
    df = spark.createDataFrame([("i", "a", "s"), ("i", "a", "t"), ("i", "b", "u")], "item string, value string, source string")
    post, _ = golden.fuse_values(df, ["item"], "value", "source", ["s", "t", "u"], rounds=0)
    w = math.log(golden.FALSE_VALUES * 0.8 / 0.2)
    total = math.exp(2 * w) + math.exp(w) + golden.FALSE_VALUES - 1
    assert {r.value: r.posterior for r in post.collect()} == pytest.approx({"a": math.exp(2 * w) / total, "b": math.exp(w) / total})


# ---- 4: canonical values


def osa(a, b):
    d = {(i, j): max(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_trie_is_exact():
    """The automaton gives what comparing with every label gives."""
    rng = random.Random(6)
    labels = {i: ["".join(rng.choice("abcd") for _ in range(rng.randint(2, 13)))] for i in range(60)}
    trie = canonical.Trie(labels)
    for _ in range(300):
        word = list(rng.choice(labels[rng.randrange(60)][0]))
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(word) + 1)
            word[k : k + rng.randint(0, 1)] = rng.choice("abcd")
        word = "".join(word)
        want = sorted((d, -len(x), i) for i, (x,) in labels.items() if (d := osa(word, x)) <= canonical.allowed(len(x)))
        assert trie.search(word) == want


def test_map_values(spark):
    entries = {1: ["customer_id", "client id"], 2: ["tonnes", "net weight"], 3: ["zip"], 4: ["discount"]}
    values = {"Customer ID": 1, "ID_Client": 1, "cust no": -1, "custmer id": 1, "NET WT": 2, "wieght net": 2, "the tonnes (required)": 2, "zip": 3, "zop": -1, "misc": -1, "disc": 4, "Mood": -1, "": None, "  ": None, None: None, "x" * 50_000: -1, "!!!": -1, "naïve": -1}
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)] * 2, "v string, entry_no int").withColumn("distance_km", F.lit(1))
    got = {r.v: r.entry for r in canonical.map_values(df, "v", entries).collect()}
    assert got == values
    assert canonical.map_values(df, "v", entries).count() == 2 * len(values)
    assert canonical.map_values(df.limit(0), "v", entries).count() == 0
    with pytest.raises(ValueError):
        canonical.map_values(df, "v", entries, most_entries=2)


# ---- 6: names

SAME = [
    ("Katherine Moss", "Kat Moss"), ("MOSS Katherine", "Moss, Katherine E."), ("K. Moss", "Katherine Moss"), ("Mr José Fernside", "Pepe Fernside"), ("Katherine Fernsidely", "Katherine Fernsdiely"),
    ("Fernside Grain Pty Ltd", "Fernside Grn Pty. Limited"), ("The Fernside Grain Co-op", "Fernside Grain Co-operative"), ("Fernside Grain & Sons", "Grain and Sons, Fernside"), ("Fernside's Grain (trading)", "Fernside Grain Ltd"), ("Zoë Ålwood", "zoe alwood"), ("Katherine Fern-side", "Kate Fernside"), ("Fernside Timver P/L", "Fernside Timber Pty Ltd"),
]
APART = [("Katherine Moss", "Edward Moss"), ("Katherine E. Moss", "Katherine F. Moss"), ("Fernside Grain Ltd", "Fernside Timber Ltd"), ("Fernside Grain Ltd", "Katherine Fernside"), ("Katherine Moss", "Katherine Vale"), ("Fernside Grain Ltd", "Fernside Grain & Sons"), ("E. Moss", "Katherine Moss"), ("Thomas Fernandside", "Thomas Fernoxside")]


#: What a large table would teach.
LEXICON = names.Lexicon(shares={"katherine": 0.02, "edward": 0.02, "josephine": 0.02, "jose": 0.02, "grain": 0.02}, firms=frozenset({"grain"}), persons=frozenset({"katherine", "edward", "jose", "josephine"}), aliases={"pepe": ("jose",)})


def test_same_party():
    same = lambda a, b: names.same_party(names.parse_name(a, LEXICON), names.parse_name(b, LEXICON), LEXICON)
    for a, b in SAME:
        assert same(a, b) and same(b, a), (a, b)
    for a, b in [*APART, ("Josephine Moss", "José Moss"), ("Edward M.", "Edward Moss"), ("Edward Katherine", "Ed. K."), ("Katherine Moss", "Moss Katherine Ltd")]:
        assert not same(a, b), (a, b)


def test_names_either_way_round_and_of_any_script():
    same = lambda a, b: names.same_party(names.parse_name(a), names.parse_name(b))
    assert same("Thomas Lee", "Thomsa Lee") and same("Thomsa Lee", "Thomas Lee") and same("J. Lee", "John Lee")
    known = ["Thomas Lee", "Thomsa Lee", "Katherine Ashcroft", "Kat Ashcrft", "Ashcroft, K", "Oakvale Grain Co", "Oakvale Grian Co", "Иван Петров", "Петров Иван", "王小明", "राम", "रमा"]
    assert all(same(a, b) == same(b, a) for a in known for b in known)
    assert names.parse_name("Иван Петров") == names.parse_name("Петров, Иван") != names.parse_name("Иван Сидоров")
    assert same("Иван Петров", "Петров Иван") and names.parse_name("राम") != names.parse_name("रमा")
    assert all(names.Name.of(names.parse_name(x).key()) == names.parse_name(x) for x in known)


def test_cosines_are_exact():
    rng = random.Random(7)
    ns = [names.parse_name(" ".join("".join(rng.choice("abcde") for _ in range(rng.randint(4, 8))) for _ in range(2))) for _ in range(80)]
    weights = np.random.default_rng(7).integers(50, 3000, names.GRAM_BUCKETS)
    lexicon = names.Lexicon(weights=weights)
    vectors = [names.vector(n) for n in ns]
    sets = [set(v.tolist()) for v in vectors]
    norm = [math.sqrt(sum(float(weights[g]) for g in s)) for s in sets]
    want = {(i, j): sum(float(weights[g]) for g in sets[i] & sets[j]) / norm[i] / norm[j] for i, j in combinations(range(len(ns)), 2)}
    got = {(i, j): s for i, j, s in names.similar_pairs(vectors, lexicon, least=0.2)}
    assert set(got) == {k for k, s in want.items() if s >= 0.2}
    assert all(abs(want[k] - s) < 1e-6 for k, s in got.items())
    sides = np.array([i % 3 for i in range(80)])
    assert {(i, j) for i, j, _ in names.similar_pairs(vectors, lexicon, sides, least=0.2)} == {(i, j) for i, j in got if i % 3 != j % 3}
    # Partners always share one of the n-grams by which spellings are spread.
    heavy = [set(names.heaviest(v, weights[v]).tolist()) for v in vectors]
    assert all(heavy[i] & heavy[j] for (i, j), s in want.items() if s >= names.COSINE)


def test_refused_pairs_are_no_parties():
    rng = random.Random(14)
    parts = ["ash", "birch", "cedar", "dune", "elder", "fern"]
    ns = [names.parse_name(f"{rng.choice(['Katherine', 'Edward', 'Kate', 'José', 'J.', 'Ed'])} {''.join(rng.sample(parts, 2))}{rng.choice(['', 'e', ' Ltd', ' M.'])}", LEXICON) for _ in range(120)]
    i, j = np.triu_indices(len(ns), 1)
    refused = names.TwoWords(ns, LEXICON).refused(i, j)
    assert refused.any() and not any(names.same_party(ns[a], ns[b], LEXICON) for a, b in zip(i[refused], j[refused], strict=True))


def test_words_are_looked_up_at_once():
    """N-grams, letters and first letters of many words equal those of each, whatever the script; so do the vectors of names."""
    ns = [names.parse_name(x) for x in ("Иван Петров", "王小明", "राम K.", "Zoë Ålwood", "Li", "Oak Oak Grain", "Katherine E. Moss", "𐐀𐐁 Moss")]
    table = names.TwoWords(ns, LEXICON)
    every = list(dict.fromkeys(w for n in ns for w in n.words))
    assert [tuple(table.words.grams[b : b + k].tolist()) for b, k in zip(table.words.begin, table.words.size, strict=True)] == [names.grams(w) for w in every]
    assert table.words.letters.tolist() == [names._bits(w) for w in every] and table.words.first.tolist() == [ord(w[0]) for w in every]
    flat, name = table.vectors()
    assert [sorted(names.vector(n).tolist()) for n in ns] == [flat[name == k].tolist() for k in range(len(ns))]
    # Also refused: a word that is met beside an initial of one name, words that begin alike, and legal forms that differ.
    apart = [("Katherine M. Moss", "Katherine Fernside"), ("Katherine Fernside", "Katherine Falbreworth"), ("Fernside Grain Ltd", "Fernside Grain & Sons")]
    near = [("Katherine M. Moss", "Katherine Mos"), ("Katherine Fernside", "Katherine Ferns"), ("Fernside Grain Ltd", "Fernside Grain"), ("K. M. Moss", "Katherine Moss")]
    for pairs, want in ((apart, True), (near, False)):
        table = names.TwoWords([names.parse_name(x, LEXICON) for pair in pairs for x in pair], LEXICON)
        assert table.refused(np.arange(0, 2 * len(pairs), 2), np.arange(1, 2 * len(pairs), 2)).tolist() == [want] * len(pairs)


def test_average_linkage():
    links = {(0, 1): 0.9, (1, 2): 0.9, (0, 2): 0.1, (3, 4): 0.8, (2, 3): 0.45}
    assert names.average_linkage(6, links, 0.4) == [0, 0, 0, 3, 3, 5]
    # A chain isn't one group: its ends have nothing in common.
    chain = {(i, i + 1): 0.6 for i in range(9)}
    assert len(set(names.average_linkage(10, chain, 0.4))) > 2
    # Spellings of one id stay together, and count as many.
    assert names.group_spellings(4, {(1, 2): 0.6, (2, 3): 0.9}, [(0, 1)]) == [0, 0, 2, 2]


def _people(spark, seed, districts=2, n=60):
    rng = random.Random(seed)
    rows, parts = [], ["ash", "birch", "cedar", "dune", "elder", "fern", "gorse", "hazel", "iris", "jute"]
    given = ["Katherine", "Edward", "Thomas", "Oliver", "Susannah", "Victoria"]
    for i in range(n):
        name = f"{rng.choice(given)} {(rng.choice(parts) + rng.choice(parts) + rng.choice(parts)).title()}"
        for k in range(rng.choice([1, 1, 2, 3])):
            first, last = name.split(" ")
            rows.append((f" c-{i:03d}{k} ", rng.choice([name, f"{last}, {first}", f"{first[0]}. {last}", name.upper(), last[:4] + last[5:] + " " + first]), f"D{i % districts}"))
    rows += [("", "Ann Ash", "D0"), ("C-x", " ", "D0"), (None, None, None), ("C-y", "Ann Ash", None), ("C-z", "W" * 50_000, "D0"), rows[0]]
    return spark.createDataFrame(rows, "id string, name string, district string").withColumn("party", F.lit("clash"))


def _pairs(df, **bounds):
    pairs = {tuple(r) for r in names.party_pairs(names.party_members(df, "id", "name", "district", **bounds)).collect()}
    if not bounds:
        assert pairs == {tuple(r) for r in names.party_pairs(names.link_parties(df, "id", "name", "district")).collect()}
    return pairs


def test_links_do_not_depend_on_the_cut(spark):
    """A table gives the very same pairs in one block, in many salted ones cut by n-grams, and grouped by district or by connected part."""
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("bcdfghklmnprstvz") + rng.choice("aeiou") for _ in range(4)).title()
    rows = [("a1", "Bartholomew Ashcroft", "S0"), ("a2", "B. Ashcroft", "S0"), *[(f"f{i}", f"{word()} {word()}", "S0") for i in range(20)]]
    # The surname stands elsewhere too; weights and rarity are those of the whole table.
    rows += [(f"g{i}", f"{word()} Ashcroft", "S1") for i in range(6)] + [(f"e{i}", f"{word()} {word()}", "S2") for i in range(700)]
    rows += [("h1", "Oak Vale Grain Co", "S0"), ("h2", "Oakvale Grain Company", "S0"), ("h3", "Oak Vaile Grain Ltd", "S0"), ("i1", "J. Li", "S0"), ("i2", "J Li", "S0"), ("i3", "Li, J", "S0")]
    rows += [("k1", "Zyx Quorl", "S0"), ("k1", "Vutu Plimf", "S0"), ("k2", "Quorl, Zyx", "S0"), ("k3", "Plimf, V.", "S0")]  # one id under two names
    df = spark.createDataFrame(rows, "id string, name string, district string").unionByName(_people(spark, 8).drop("party"))
    whole = _pairs(df)
    assert {("A1", "A2"), ("I1", "I2"), ("K1", "K2"), ("K1", "K3"), ("K2", "K3")} <= whole and all(a < b for a, b in whole)
    for bounds in ({"block": 12}, {"block": 4, "part": 0}, {"part": 3}):
        assert _pairs(df, **bounds) == whole
    assert _pairs(df.limit(0)) == set()


def test_components(spark):
    """Long paths in any order of their nodes, stars and pairs, against union by hand."""
    rng = random.Random(12)
    path = rng.sample(range(-500, 500), 200)
    edges = list(zip(path, path[1:], strict=False)) + [(1000, 1000 + i) for i in range(50)] + [(i, i + 1) for i in range(2000, 2100)] + [(5000, 5001), (5001, 5000), (7, 7)]
    got = {r.node: r.part for r in names.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    parts = [set(path), set(range(1000, 1050)), set(range(2000, 2101)), {5000, 5001}]
    assert set(got) == set().union(*parts) and all(len({got[x] for x in p}) == 1 for p in parts) and len(set(got.values())) == 4
    assert names.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_exchanged_words_are_learnt(spark):
    """Names written with a pet form, a short form or a pet form given beforehand meet; a relative's name doesn't."""
    rng = random.Random(13)
    surname = lambda: "".join(rng.choice("bcdfghklmnprstvz") + rng.choice("aeiou") for _ in range(5)).title()
    given = ["Robert", "Ingrid", "Walter", "Harriet", "Douglas", "Felicity"]
    rows, n = [], 0
    for i in range(240):
        last = surname()
        for g in rng.sample(given, 2):
            rows.append((f"p{n}", f"{g} {last}", f"D{i % 5}"))
            if g == "Robert" and i % 3 == 0:
                rows.append((f"q{n}", f"Bob {last}", f"D{i % 5}"))
            n += 1
    df = spark.createDataFrame(rows + [("x1", "Dickon Ashcombe", "D0"), ("x2", "Richard Ashcombe", "D0")], "id string, name string, district string")
    nicknames = {"dickon": ["richard"]}
    want = {(f"P{i[1:]}", i.upper()) for i, _, _ in rows if i.startswith("q")}
    assert _pairs(df, nicknames=nicknames) == want | {("X1", "X2")}


@pytest.mark.parametrize("least", [1, 3])
def test_every_exchange_counts(spark, least):
    """All pairs of the words that meet in a remainder count, however many meet there, against brute force."""
    rng = random.Random(16)
    given = ["".join(rng.sample("abcdefghijklmnop", 5)) for _ in range(40)]
    rows = [(f"D{d}", " ".join(sorted((g, last)))) for d in range(2) for k, last in enumerate(["quorl", "ruvt", "swyz", "tuwx"]) for g in rng.sample(given, 3 + 12 * k)]
    rows += [("D0", "usual quorl"), ("D0", "rare quorl usual"), ("D0", "usual"), ("D0", "quorl quorl"), ("D1", "usual zz"), rows[0]]
    spots = {}
    for d, text in rows:
        words = text.split()
        for i, w in enumerate(words):
            rest = (d, *words[:i], *words[i + 1 :])
            if set(rest[1:]) - {"usual"}:
                spots.setdefault(rest, set()).add(w)
    want = {}
    for met in spots.values():
        for pair in combinations(sorted(met), 2):
            want[pair] = want.get(pair, 0) + 1
    met = names._meetings(spark.createDataFrame([(d, f"{x}|||") for d, x in rows], "district string, key string"), ["usual"])
    assert sum(r.others for r in met.collect()) == 2 * sum(want.values()) and max(map(len, spots.values())) > 30
    assert {(r.a, r.b): r.n for r in names._exchanged(met, least).collect()} == {k: n for k, n in want.items() if n >= least}


# ---- 8: tokens


@pytest.fixture(scope="module")
def merges():
    return tok.Merges.load(tok.tokenizer_file())


def texts(spark):
    return [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect()] + ["", None, " \t\n ", "<|endoftext|>", "日本語テキスト", "a" * 20_000, "é" * 9_000, "🙂🙃" * 500, "x\x00y", "ab" * 5000 + " c"]


def test_tokens_equal_the_library(spark, merges):
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers as P

    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=merges.ranks, special_tokens={})
    t = tok.Transducer(merges, P.PATTERN)
    d = tok.Decoder(merges)
    for x in texts(spark):
        ids = t.encode(x)
        assert ids == (enc.encode_ordinary(x) if x else [])
        assert d.decode(ids) == (x or "")


def test_stream_is_bounded_and_equal(spark, merges):
    """However a piece arrives, the ids are those of the whole; nothing is held beyond window and lookahead."""
    t = tok.Transducer(merges, ".+", window=32)
    assert t.lookahead < 2000
    rng = random.Random(9)
    for x in ["".join(rng.choice("abcdeé ") for _ in range(3000)), "a" * 3000, "the cat sat on the mat " * 150]:
        data = x.encode()
        cuts = sorted(rng.sample(range(len(data)), 40))
        chunks = [data[a:b] for a, b in zip([0, *cuts], [*cuts, len(data)], strict=True)]
        assert list(t.stream(chunks)) == [merges.ranks[p] for p in merges.encode(data)]


def test_decoder_takes_any_bytes(merges):
    rng, d = random.Random(10), tok.Decoder(merges)
    for _ in range(500):
        data = bytes(rng.choice([0x41, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x80, 0xFF, 0xED, 0xA0]) for _ in range(9))
        assert d.decode([merges.single[b] for b in data]) == data.decode("utf-8", "replace")


def test_encode_texts(spark):
    df = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (3, "hello hello", "k")], "i int, text string, ids string")
    got = tok.encode_texts(df, "text", ["i"]).orderBy("i").collect()
    assert [list(r.ids) for r in got] == [[], [], [31373, 23748]]
    assert [r.n_tokens for r in tok.encode_texts(df, "text", ["i"], count_only=True).orderBy("i").collect()] == [0, 0, 2]
    assert tok.encode_texts(df.limit(0), "text", ["i"]).count() == 0


def test_decode_ids(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [31373, 23748]), (4, [31373, None])], "text int, n array<int>")
    got = tok.decode_ids(df.withColumn("i", F.col("text")), "n", ["i"]).orderBy("i").collect()
    assert [r.text for r in got] == ["", "", "hello hello", "hello"]
    odd = spark.createDataFrame([(x,) for x in texts(spark)], "text string").withColumn("i", F.monotonically_increasing_id()).persist()
    back = tok.decode_ids(tok.encode_texts(odd, "text", ["i"]), "ids", ["i"])
    assert odd.join(back.withColumnRenamed("text", "again"), "i").where("coalesce(text, '') <> again").count() == 0 and back.count() == odd.count()
    assert tok.decode_ids(df.limit(0), "n", []).count() == 0


# ---- 9: mixing


def test_plan():
    totals = {"a": (10, 1000), "b": (5, 100), "other": (3, 50)}
    p = {x.source: x for x in mixing.plan_mix(totals, {"a": (0.5, 2), "b": (0.3, 3), "none": (0.2, 9)})}
    sizes = {s: x.copies * x.tokens for s, x in p.items()}
    assert sizes["b"] == pytest.approx(300) and sizes["a"] == pytest.approx(500) and p["none"].copies == 0
    capped = {x.source: x for x in mixing.plan_mix(totals, {"a": (0.5, 2), "b": (0.5, 3)}, total=1500)}
    assert capped["b"].copies == 3 and capped["a"].copies * 1000 == pytest.approx(1200)
    assert all(x.copies == 0 for x in mixing.plan_mix({}, {"a": (1.0, 1)}))


def test_pivot_keeps_sums_and_chances():
    hits, rounds = [0] * 7, 4000
    ps = [0.1, 0.5, 0.9, 0.25, 0.25, 0.5, 0.5]
    for seed in range(rounds):
        out = {}
        left = mixing.pivot([(str(i), p) for i, p in enumerate(ps)], seed, out.__setitem__)
        assert left is None and sum(out.values()) == 3
        for i in range(7):
            hits[i] += out[str(i)]
    assert all(abs(h / rounds - p) < 0.03 for h, p in zip(hits, ps, strict=True))


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 50)
    monkeypatch.setattr(mixing, "FAN_IN", 4)
    rows = [(i, "big", 100 + i % 7) for i in range(3000)] + [(10_000 + i, "small", 100) for i in range(200)] + [(20_000, None, 5), (20_001, "unlisted", 5), (20_002, "big", 0)]
    df = spark.createDataFrame(rows, "doc long, src string, n long").withColumn("key", F.lit("clash"))
    plans = mixing.plan_mix(mixing.source_totals(df, "src", "n"), {"big": (0.7, 1), "small": (0.3, 3), "gone": (0.1, 1)})
    r = mixing.round_copies(df, plans, "doc", "src", "n").persist()
    assert r.count() == 3201 and r.groupBy("source").agg(F.max("copies")).where("source = 'small'").first()[1] <= 3
    s = {x.source: x for x in mixing.shares_reached(r, plans).collect()}
    assert abs(s["big"].actual_share - 0.7) < 0.005 and abs(s["small"].actual_share - 0.3) < 0.005 and s["gone"].tokens == 0
    again = mixing.round_copies(df.repartition(7), plans, "doc", "src", "n")
    assert sorted(r.select("key", "copies").collect()) == sorted(again.select("key", "copies").collect())
    assert mixing.round_copies(df.limit(0), plans, "doc", "src", "n").count() == 0


def test_settle(spark):
    """A source with a few huge records comes near its share, and no record leaves the numbers next to its fraction."""
    rng = random.Random(11)
    rows = [(i, "s", rng.choice([10, 20, 30, 40_000 if i % 40 == 0 else 50])) for i in range(400)] + [(1000 + i, "t", 100) for i in range(900)]
    df = spark.createDataFrame(rows, "doc long, src string, n long")
    plans = mixing.plan_mix(mixing.source_totals(df, "src", "n"), {"s": (0.4, 1), "t": (0.6, 3)})
    r = mixing.round_copies(df, plans, "doc", "src", "n").persist()
    done = mixing.settle(r, plans)
    far = lambda x: {y.source: abs(y.actual_share - y.wanted_share) for y in mixing.shares_reached(x, plans).collect()}
    assert far(done)["s"] <= far(r)["s"] and far(done)["s"] < 0.02
    c = {p.source: p.copies for p in plans}
    assert all(abs(x.copies - c[x.source]) < 1 for x in done.collect())


# ---- 10: garbled text

CLEAN = ["Die Lieferung für Müller war überfällig – „später“.", "L’été était à l’heure, déjà vérifié.", "Ключ пропущен в последних строках, вероятно.", "Zażółć gęślą jaźń, wagę sprawdził.", "¿Por qué el año está en otra columna?", "“Quoted” — it’s 5 € only… café"]


@pytest.mark.parametrize("encoding", ["cp1252", "latin-1", "cp1251", "cp437", "mac_roman"])
@pytest.mark.parametrize("text", CLEAN)
def test_round_trip(text, encoding):
    """What UTF-8 bytes become through a legacy encoding comes back, once and twice garbled, alone or inside clean text."""
    wrong = "".join(chr(b) if e is None else e for b in text.encode() for e in [_char(b, encoding)])
    got = garbled.restore(wrong)
    assert (got.text, got.lost) == (text, 0) and got.spans > 0
    assert garbled.restore(f"All fine here. {wrong}")[0] == f"All fine here. {text}"


def _char(b, encoding):
    try:
        return bytes([b]).decode(encoding)
    except UnicodeDecodeError:
        return None


@pytest.mark.parametrize("times", [2, 3, 7, 12])
def test_several_times(times):
    wrong = CLEAN[0]
    for _ in range(times):
        wrong = wrong.encode().decode("latin-1")
    assert garbled.restore(wrong).text == CLEAN[0]


#: Scripts of many kinds; the operator knows none of them by name.
SCRIPTS = ["שלום עולם, זה לא תקין", "مرحبا بالعالم في هذا النص", "สวัสดีชาวโลก ข้อความนี้", "Բարեւ աշխարհ այս տեքստը", "नमस्ते दुनिया यह पाठ", "안녕하세요 세계 이 글은", "გამარჯობა მსოფლიო", "これは日本語の文章です。", "Γειά σου κόσμε, και πάλι", "ሰላም ለዓለም"]


@pytest.mark.parametrize("encoding", ["latin-1", "cp1252"])
@pytest.mark.parametrize("text", SCRIPTS)
def test_any_script(text, encoding):
    wrong = "".join(chr(b) if e is None else e for b in text.encode() for e in [_char(b, encoding)])
    assert garbled.restore(wrong).text == text and garbled.restore(text) == (text, 0, 0, 0)
    assert garbled.restore(f"note: {wrong} (end)").text == f"note: {text} (end)"


@pytest.mark.parametrize("text", [*CLEAN, "", None, "plain", "SÃO NECESSÁRIAS ASSINATURAS, CORREÇÃO", "prints “Ã©” wherever the form has “é”", "a heading shows â€™ in the preview", "the three characters ï»¿ at the start", "«РФ», СССР» и «США»", "«École» et “Été” — à l’étranger", "café naïve", "Ångström ÄÖÜ", "x" * 200_000])
def test_left_alone(text):
    assert garbled.restore(text) == (text, 0, 0, 0)


def test_other_damage():
    assert garbled.restore("Çàãîëîâîê íå îòíîñèòñÿ íè ê îäíîìó ïîëþ.")[0] == "Заголовок не относится ни к одному полю."
    assert garbled.restore("For the record � 5 rows").lost == 1
    assert garbled.restore("corrigÈ la ligne aprËs avoir relu")[0] == "corrigé la ligne après avoir relu"


def test_restore_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "fÃ¼r"), (3, "fÃ¼r")], "i int, text string").withColumn("spans", F.lit("clash"))
    got = garbled.restore_texts(df, "text", ["i"]).orderBy("i").collect()
    assert [(r.i, r.restored, r.spans) for r in got] == [(1, None, 0), (2, "", 0), (3, "für", 1), (3, "für", 1)]
    assert garbled.restore_texts(df.limit(0), "text", ["i"]).count() == 0

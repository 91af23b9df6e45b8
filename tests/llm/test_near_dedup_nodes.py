"""Repeated doc_ids and texts made to defeat weak hashes."""

from tessera.llm import minhash
from tests.llm.test_operators import got

COLUMNS = ("doc_id", "n_shingles", "component_id", "kept")


def words(name, n=60, changed=0):
    return " ".join(f"{name}{i}" if i >= changed else f"{name}new{i}" for i in range(n))


def thue_morse(n, flip=False):
    return "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(n))


def test_every_set_of_a_repeated_doc_id_keeps_its_links(spark):
    rows = [(1, words("a")), (1, words("b")), (2, words("a", changed=1)), (3, words("b", changed=1)), (4, words("c")), (4, ""), (5, words("c", changed=1)), (6, "")]
    df = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got(df, "doc_id", "component_id") == {(1, 1): 2, (2, 1): 1, (3, 1): 1, (4, 4): 2, (5, 4): 1, (6, 6): 1}


def test_null_ids_are_one_node_before_all_others(spark):
    rows = [(None, words("a")), (None, words("b")), (None, None), (2, words("a", changed=1)), (3, words("b", changed=1)), (4, words("d"))]
    df = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got(df, "doc_id", "component_id", "kept") == {(None, None, True): 3, (2, None, False): 1, (3, None, False): 1, (4, 4, True): 1}


def test_words_that_collide_modulo_powers_of_two_are_different(spark):
    rows = [(1, thue_morse(2048)), (2, thue_morse(2048, True)), (3, thue_morse(2048))]
    df = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got(df, *COLUMNS) == {(1, 1, 1, True): 1, (2, 1, 2, True): 1, (3, 1, 1, False): 1}


def test_a_family_that_shares_most_of_its_text(spark):
    """Two thousand texts with 130 words in common and 50 of their own, and copies of some with one word changed."""
    common = words("x", 130)
    rows = [(i, f"{common} {words(f'own{i}_', 50)}") for i in range(2000)]
    rows += [(10_000 + i, f"{common} {words(f'own{i}_', 50, changed=1)}") for i in range(0, 2000, 40)]
    df = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    done = {r["doc_id"]: r["component_id"] for r in df.collect()}
    assert done == {i: i if i < 10_000 else i - 10_000 for i, _ in rows}


def test_long_near_copies_below_the_limit_are_told_apart(spark):
    """Three texts of 20,000 words, each pair at about 0.78: a bucket of three components, compared by long prefixes."""
    base = [f"w{i * 7919 % 1_000_003}" for i in range(20_000)]
    docs = [(d, " ".join(f"x{d}" if i % 80 == 27 * d else w for i, w in enumerate(base))) for d in range(3)] + [(9, " ".join(base[:-1]))]
    found = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    sets = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for d, w in ((d, t.split()) for d, t in docs)}
    near = lambda a, b: 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])
    assert not near(0, 1) and not near(1, 2) and not near(0, 2) and all(near(d, 9) for d in range(3))
    assert set(found.values()) == {0}

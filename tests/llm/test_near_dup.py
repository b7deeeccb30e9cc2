import random
import re

import pytest

from fringe.llm import near_dup, scratch
from fringe.llm.near_dup import deduplicate, near_duplicates
from fringe.llm.textset import shingle_sets

SCHEMA = "doc_id long, text string, source string, n_shingles int"


def brute(rows, width, percent=80):
    """Components by comparing all pairs of exact word-shingle sets."""
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else ({tuple(words)} if words else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    out = {}
    for members in groups.values():
        low = min((rows[i][0] for i in members if rows[i][0] is not None), default=None)
        for i in members:
            out[i] = (len(sets[i]), low)
    return out


def corpus(seed=1, groups=6, size=45):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice((6, 30, 120)))]
        for _ in range(rng.choice((1, 3, size))):
            copy = list(base)
            for _ in range(rng.choice((0, 0, 1, 2, 4))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append(" ".join(copy))
    shared = " ".join(rng.choice(vocabulary) for _ in range(20))
    rows += [shared + " " + " ".join(rng.choice(vocabulary) for _ in range(40)) for _ in range(40)]
    rng.shuffle(rows)
    return [(i * 3 % 1001, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize(("width", "small_list"), [(2, 32), (2, 4), (5, 4)])
def test_components_equal_brute_force(spark, width, small_list):
    rows = corpus() + [(2001, None), (2002, ""), (2003, " \t\n"), (2004, "One"), (2005, "one"), (2006, "ONE two"), (None, "one two"), (2007, "É é"), (2008, "é é")]
    rows += [rows[0], rows[5]]
    df = spark.createDataFrame([(i, t, "s", 7) for i, t in rows], SCHEMA)
    got = near_duplicates(df, width=width, small_list=small_list).collect()
    want = brute(rows, width)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in got) == sorted((rows[i][0] is None, rows[i][0] or 0, n, c) for i, (n, c) in want.items())
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_deduplicate_keeps_one_row_of_each_component_and_all_columns(spark):
    rows = corpus(seed=3, groups=4) + [(3001, None), (3002, ""), (3002, "")]
    rows += [rows[0], (5000, rows[1][1])]
    df = spark.createDataFrame([(i, t, f"s{i % 3}", 7) for i, t in rows], SCHEMA)
    out = deduplicate(df, width=5)
    assert out.columns == df.columns
    want = brute(rows, 5)
    kept = [r.doc_id for r in out.collect()]
    components = {c for i, (n, c) in want.items() if n}
    assert sorted(kept) == sorted([*components, 3001, 3002, 3002])


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert near_duplicates(df).count() == 0
    assert deduplicate(df).count() == 0


def test_long_text_and_hash_sets():
    text = "a b " * 50_000
    (one, two) = shingle_sets([text, "A\x0bB\x0ca"], 2)
    assert len(one) == 2 and set(two) == set(one)


def test_clashing_names(spark):
    text = "one two three four five six seven eight nine ten"
    df = spark.createDataFrame([(1, text, 1, 2, 3), (2, text, 4, 5, 6), (None, None, 7, 8, 9)], "doc_id long, text string, take_text int, take_id int, node int")
    out = deduplicate(df)
    assert out.columns == df.columns and sorted(out.collect(), key=str) == sorted([r for r in df.collect() if r.doc_id != 2], key=str)


def test_few_links_are_joined_without_rounds(spark, monkeypatch):
    from fringe.llm import components

    rng = random.Random(5)
    links = [(f"n{rng.randrange(300):03}", f"n{rng.randrange(300):03}") for _ in range(200)] + [("n001", None), ("n002", "n002")]
    table = spark.createDataFrame(links, "a string, b string")
    tracker = spark.sparkContext.statusTracker()
    results, jobs = [], []
    for few in (50_000, -1):
        monkeypatch.setattr(components, "FEW_LINKS", few)
        before = len(tracker.getJobIdsForGroup(None))
        results.append(sorted(map(tuple, components.connected_components(table).collect())))
        jobs.append(len(tracker.getJobIdsForGroup(None)) - before)
        assert components.connected_components(table.where("a = 'none'")).count() == 0
    assert results[0] == results[1] and results[0]
    assert jobs[0] < jobs[1] / 2


def test_written_tables_leave_no_shuffle_files(spark):
    from fringe.llm.scratch import materialize

    files = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    before = set(re.findall(r"shuffle_\d+", files()))
    assert materialize(spark.range(1000).groupBy("id").count(), "counts").count() == 1000
    after = set(re.findall(r"shuffle_\d+", files())) - before
    assert len(after) <= 1  # that of the count


def test_full_sets_keep_one_python_worker_for_a_core(spark):
    """The stage that makes full sets has one Python node even where the wanted nodes are broadcast: workers of a second one stay in memory."""
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "g h i j k l"), (3, None), (4, "m n"), (5, "not asked for")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    nodes = near_dup.sketch(docs, "doc_id", "text", 5, 32).where("node is not null and not id <=> 5")
    wanted = scratch.materialize(nodes.groupBy("node").agg(near_dup.F.min(near_dup.F.struct("id", "text_key")).alias("at")).select("node", "at.id", "at.text_key"), "wanted")
    sets = near_dup.full_sets(docs, wanted, "doc_id", "text", 5)
    plan = sets._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") + plan.count("EvalPython") == 1
    want = sorted(sorted(s.view("int64").tolist()) for s in shingle_sets(["a b c d e f", "g h i j k l", "m n"], 5))
    assert sorted(sorted(r.hashes) for r in sets.collect()) == want
    assert {bytes(r.node) for r in sets.collect()} == {bytes(r.node) for r in wanted.collect()}


def test_texts_and_full_sets_go_to_python_in_short_batches(spark, monkeypatch):
    """Steps that hand whole texts or sets to Python do so some megabytes at a time, whatever the rows' length."""
    rows_at = {}

    def noted(df, name):
        rows_at[name] = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
        return scratch.materialize(df, name)

    monkeypatch.setattr(near_dup, "materialize", noted)
    deduplicate(spark.createDataFrame([(i, f"a b c d e f g h i j {i // 2}") for i in range(8)], "doc_id long, text string")).collect()
    assert {rows_at[n] for n in ("sketch", "sets", "linked")} == {scratch.BATCH_ROWS}

    def sizes(batches):
        for b in batches:
            yield near_dup.pa.RecordBatch.from_arrays([near_dup.pa.array([b.nbytes])], ["n"])

    with scratch.short_batches(spark):
        most = max(r.n for r in spark.range(2000).coalesce(1).selectExpr("repeat('x', 20000) as text").mapInArrow(sizes, "n long").collect())
    assert most < 1.5 * scratch.BATCH_BYTES

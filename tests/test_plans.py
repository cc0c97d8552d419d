"""Plans that divide hot groups give what one plain pass over all rows gives."""

import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from tidemark.catalog import QUERIES
from tidemark.operators import episodes, graph, runs
from tidemark.operators import identity as ident
from tidemark.plans import grid
from tidemark.plans.scan import Scan


def _episodes(rows, gap, scope, least):
    """(episode's first event, event, position) in plain Python."""
    groups = {}
    for event_id, ts, channel, thread in rows:
        if scope == "thread" and thread is None:
            continue
        key = {"thread": thread, "channel": channel, "global": "global"}[scope]
        groups.setdefault(key, []).append((ts, event_id))
    out = set()
    for own in groups.values():
        own.sort()
        run = []
        for ts, event_id in [*own, (None, None)]:
            if run and (ts is None or ts - run[-1][0] > gap):
                if len(run) >= least:
                    out |= {(run[0][1], e, i + 1) for i, (_, e) in enumerate(run)}
                run = []
            run.append((ts, event_id))
    return out


@pytest.mark.parametrize("scope", ["thread", "channel", "global"])
@pytest.mark.parametrize("stretch", [None, 7, 100, 10**6])
def test_time_gaps_carried_over_stretches(spark, scope, stretch):
    rng = random.Random(f"{scope}{stretch}")
    rows = [(i, rng.choice([rng.randint(0, 300), rng.randint(0, 3000)]), rng.choice(["a", "b", None]), rng.choice(["t", "u", None])) for i in range(400)]
    df = spark.createDataFrame(rows, "event_id long, ts long, channel string, thread_id string")
    for least in (1, 4):
        placed = episodes.time_gap(df, 10, scope=scope, least_events=least, stretch=stretch).collect()
        first = {r.episode_id: r.event_id for r in placed if r.position == 1}
        assert {(first[r.episode_id], r.event_id, r.position) for r in placed} == _episodes(rows, 10, scope, least)
        assert len(placed) == len({r.event_id for r in placed})
    numbers = episodes.gap_groups(df, 10, scope, stretch).collect()
    seen = {}
    for r in numbers:
        seen.setdefault(r.scope_key, set()).add(r.episode_no)
    assert all(n == set(range(1, len(n) + 1)) for n in seen.values())


def test_gap_of_exactly_the_threshold(spark):
    df = spark.createDataFrame([(1, 0, "c", "t"), (2, 3600, "c", "t"), (3, 7201, "c", "t")], "event_id long, ts long, channel string, thread_id string")
    got = {r.event_id: r.position for r in episodes.time_gap(df, 3600, scope="channel").collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_contradictions_in_order_against_every_later_edge(spark):
    rng = random.Random(8)
    rows = [(str(i), rng.choice("ab"), rng.choice(["x", "y", "z"]), rng.choice([None, *[f"20{k:02}" for k in range(12)]]), rng.choice([None, None, "2050"])) for i in range(160)]
    df = spark.createDataFrame([(i, s, "WORKS_AT", t, None, v, e) for i, s, t, v, e in rows], "relationship_id string, source_entity_id string, relation_type string, target_entity_id string, target_literal string, valid_at string, invalid_at string")
    want = set()
    own = [r for r in rows if r[3] is not None and r[4] is None]
    for i, s, t, v, _ in own:
        later = [v2 for _, s2, t2, v2, _ in own if s2 == s and t2 != t and v2 > v]
        if later:
            want.add((i, min(later)))
    assert {tuple(r) for r in graph.contradictions_in_order(df).collect()} == want


@pytest.mark.parametrize("block", [1, 3, 100])
def test_embedding_candidates_against_all_pairs(spark, block):
    rng = np.random.default_rng(block)
    vectors = [rng.normal(0, 1, 4).tolist() for _ in range(20)] + [[0.0] * 4, [], [1.0, 2.0], None]
    mentions = spark.createDataFrame([(f"m{i}", v) for i, v in enumerate(vectors)], "mention_id string, embedding array<double>")
    entities = spark.createDataFrame([("entity", f"e{i}", v) for i, v in enumerate(vectors)] + [("event", "x", vectors[0])], "target_type string, target_id string, embedding array<double>")

    def score(a, b):
        usable = len(a) == len(b) > 0 and np.linalg.norm(a) > 0 and np.linalg.norm(b) > 0
        return (float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)) + 1) / 2 if usable else 0.5

    for least in (0.85, 0.4):
        got = {(r.mention_id, r.entity_id): r.embedding_score for r in graph.embedding_candidates(mentions, entities, least, block).collect()}
        want = {(f"m{i}", f"e{j}"): score(a, b) for i, a in enumerate(vectors) for j, b in enumerate(vectors) if a is not None and b is not None and score(a, b) >= least}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    assert graph.embedding_candidates(mentions.limit(0), entities).count() == 0


def test_large_groups_are_reported_whole(spark):
    rows = [(f"p{i:03}", "email_work", "Team@Firm.example" if i % 2 else "team@firm.example ", 0.9) for i in range(120)] + [("q", "email_work", "q@firm.example", 1.0)]
    df = spark.createDataFrame(rows, "person_id string, fact_type string, fact_value string, confidence double")
    got = ident.collision_members(df, ident.TIER1, normalize=True).collect()
    assert len(got) == 120 and {(r.fact_value, r.person_count) for r in got} == {("team@firm.example", 120)}
    shared = ident.co_occurrence(spark.createDataFrame([(1, i) for i in range(70)], "event_id long, contact_id long"), spark.createDataFrame([(i, f"p{i:02}") for i in range(70)], "contact_id long, person_id string"))
    assert shared.count() == 70 * 69 // 2


def test_no_plan_compares_all_with_all(spark, sf_dir):
    for name in ("embedding_candidates", "contradictions_in_order", "time_gap_channel_episodes", "facet_extract", "shell_invocations"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.fixture
def many_tasks(spark):
    """Small exchanges stay divided."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def _events(seed, n=400, ties=True):
    rng = random.Random(seed)
    rows = [(f"e{i:04}", rng.choice([None, *range(60 if ties else 4000)]), "c", rng.choice(["hot"] * 6 + ["t", "u", "", None]), rng.choice(["sent", "received", "observed", None])) for i in range(n)]
    return rows, "event_id string, ts long, channel string, thread_id string, direction string"


def _same(a, b, *columns):
    assert sorted((tuple(r) for r in a.select(*columns).collect()), key=str) == sorted((tuple(r) for r in b.select(*columns).collect()), key=str)


@pytest.mark.parametrize("k", [1, 3, 50])
def test_scans_in_stretches_give_what_windows_give(spark, many_tasks, k):
    rows, schema = _events(k)
    df = spark.createDataFrame(rows, schema).repartition(5)
    made = [Scan(df, ["thread_id"], ["ts", "event_id"], most).total((F.col("direction") == "sent").cast("int"), "sent").previous(F.col("direction"), k, "before") for most in (10**6, 20)]
    assert [m.divided for m in made] == [False, True]
    _same(made[0].result(), made[1].result(), *df.columns, "sent", F.col("before").cast("string"))
    stretches = made[1].rows.where("thread_id = 'hot'").select("__part").distinct().count()
    assert stretches > 1
    # By hand: the values before each row of a thread.
    want = []
    for thread in {r[3] for r in rows}:
        own = sorted((r for r in rows if r[3] == thread), key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
        want += [(r[0], [x[4] for x in own[max(0, i - k) : i]][::-1]) for i, r in enumerate(own)]
    assert sorted((r.event_id, r.before) for r in made[1].result().collect()) == sorted(want)


def test_strategies_on_hot_threads(spark, many_tasks):
    rows, schema = _events(9)
    df = spark.createDataFrame(rows, schema)
    for tools in (False, True):
        _same(*(episodes.turn_pairs(df, include_tools=tools, most=m) for m in (10**6, 10)), "episode_id", "event_id", "turn", "position")
    _same(*(episodes.by_thread(df, most=m) for m in (10**6, 10)), "episode_id", "event_id", "position")
    _same(*(episodes.by_count(df, 7, least_events=3, most=m) for m in (10**6, 10)), "episode_id", "event_id", "position")
    _same(*(episodes.sent_before(df, most=m) for m in (10**6, 10)), "event_id", "sent_before")
    cut = df.selectExpr("event_id AS episode_id", "thread_id AS channel", "ts AS start_time")
    _same(*(episodes.before_each(cut, 3, most=m) for m in (10**6, 10)), "episode_id", "previous_id", "rank")


def test_numbers_of_the_bus_are_given_in_parallel(spark, many_tasks):
    bus = spark.createDataFrame([(7, "t", "a", "0", None, 1)], "seq long, type string, adapter string, event_id string, payload_json string, created_at long")
    rows = [("x", "a", f"e{i}", None, i * 37 % 101) for i in range(300)]
    out = runs.emit(bus, spark.createDataFrame(rows, "type string, adapter string, event_id string, payload_json string, created_at long").repartition(4))
    got = [r.event_id for r in out.orderBy("seq").collect()]
    assert got == ["0", *[r[2] for r in sorted(rows, key=lambda r: (r[4], r[0], r[2]))]] and {r.seq for r in out.collect()} == set(range(7, 308))
    assert runs.emit(bus, bus.limit(0).drop("seq")).count() == 1
    # One exchange into one partition, of the stretches' counts.
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("windowspecdefinition(__part") >= 1 and "windowspecdefinition(created_at" not in plan


def _in_turn(pairs, values):
    """Sequential merging, by groups as sets."""
    group = {p: {p} for a, b, _ in pairs for p in (a, b)}
    refused = []
    for a, b, _ in sorted(pairs, key=lambda e: (-e[2], e[0], e[1])):
        if group[a] is group[b]:
            continue
        held = [{t: {v for p, t2, v in values if p in g and t2 == t} for t in ident.UNIQUE_FACTS} for g in (group[a], group[b])]
        if any(held[0][t] and held[1][t] and not held[0][t] & held[1][t] for t in held[0]):
            refused.append((a, b))
            continue
        both = group[a] | group[b]
        for p in both:
            group[p] = both
    return sorted((p, min(g)) for p, g in group.items()), sorted(refused)


@pytest.mark.parametrize("seed", range(2))
def test_merges_in_order_are_those_of_a_sequential_run(spark, seed):
    rng = random.Random(seed)
    people = [f"p{i:02}" for i in range(24)]
    pairs = {}
    for _ in range(30):
        a, b = sorted(rng.sample(people, 2))
        pairs[a, b] = rng.choice([0.9, 0.8, 0.7])
    pairs = [(a, b, c) for (a, b), c in pairs.items()]
    values = [(p, rng.choice(["birthdate", "ssn"]), rng.choice(["1", "2", "2", "2"])) for p in people for _ in range(rng.choice([0, 1, 1, 2]))]
    facts = spark.createDataFrame([*values, ("p00", "employer_current", "x"), ("p01", "ssn", None)], "person_id string, fact_type string, fact_value string")
    candidates = spark.createDataFrame([*pairs, (None, "p1", 1.0), ("p1", "p1", 1.0), *pairs[:9]], "p1 string, p2 string, confidence double")
    want = _in_turn(pairs, values)
    assert want[1] and len({c for _, c in want[0]}) < len(want[0])
    for most in (10**6, 0) if seed == 0 else (30,):
        mapping, refused = ident.merges_in_order(candidates, facts, most)
        assert (sorted(map(tuple, mapping.collect())), sorted(map(tuple, refused.collect()))) == want


def test_no_merges_of_nothing(spark):
    mapping, refused = ident.merges_in_order(spark.createDataFrame([], "p1 string, p2 string, confidence double"), spark.createDataFrame([], "person_id string, fact_type string, fact_value string"))
    assert mapping.count() == 0 and refused.count() == 0


@pytest.mark.parametrize("query_block,item_block", [(2, 3), (50, 7), (100, 100)])
def test_best_vectors_over_a_grid(spark, query_block, item_block):
    rng = np.random.default_rng(query_block)
    items = [(f"i{n:02}", rng.integers(-2, 3, 3).astype(float).tolist()) for n in range(40)] + [("null", None), ("none", []), ("odd", [1.0])]
    queries = [(n, rng.integers(-2, 3, 3).astype(float).tolist()) for n in range(9)] + [(90, [0.0, 0.0, 0.0]), (91, None)]

    def score(a, b):
        usable = len(a) == len(b) > 0 and np.linalg.norm(a) > 0 and np.linalg.norm(b) > 0
        return round((float(np.clip(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b), -1, 1)) + 1) / 2 if usable else 0.5, 9)

    q, i = spark.createDataFrame(queries, "query_id long, vector array<double>"), spark.createDataFrame(items, "item_id string, vector array<float>")
    got = sorted((r.query_id, r.item_id, round(r.score, 9)) for r in grid.cosine_pairs(q, i, 0.6, 5, query_block, item_block).collect())
    want = []
    for n, a in queries:
        scored = sorted((-score(a, b), m) for m, b in items if a is not None and b is not None and score(a, b) >= 0.6)
        # Equal scores may differ in their last bit: by rounded scores all that could be among the best.
        want.append((n, [s for s, _ in scored[:5]], {(m, s) for s, m in scored}))
    for n, scores, every in want:
        own = [(m, -s) for q_, m, s in got if q_ == n]
        assert sorted(s for _, s in own) == scores and set(own) <= every
    plan = grid.cosine_pairs(q, i, 0.6, 5, query_block, item_block)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapCoGroupsInArrow") == 1 and "Union" not in plan


def test_names_in_names_by_their_rarest_piece(spark):
    rng = random.Random(3)
    names = {"".join(rng.choices("ab", k=rng.randint(3, 14))) for _ in range(120)} | {"éé", "ééa", "ééab", "aéé", "漢字", "漢字a", "日本語", "日本語ab", "x漢字y"}
    df = spark.createDataFrame([(n,) for n in sorted(names)] * 2, "name string")
    size = lambda n: len(n.encode())
    want = {(a, b) for a in names for b in names if a != b and a in b and size(a) >= 4 and size(a) / size(b) > 0.5}
    got = [tuple(r) for r in ident.name_links(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    # What the pairs of persons say is what the classes say, expanded.
    persons = spark.createDataFrame([(f"p{i}", n, None if i % 3 else n + "a") for i, n in enumerate(sorted(names))] + [("q", "ab" * 3, None)], "person_id string, canonical_name string, display_name string")
    pairs = {tuple(r) for r in ident.name_similarity(persons).select("p1", "p2").collect()}
    classes = ident.name_classes(persons).collect()
    by = {}
    for r in classes:
        by.setdefault(r.name, set()).add(r.person_id)
    expanded = {tuple(sorted((a, b))) for m in by.values() for a in m for b in m if a < b} | {tuple(sorted((a, b))) for s, t in ((r.short, r.long) for r in ident.name_links(spark.createDataFrame([(n,) for n in by], "name string")).collect()) for a in by[s] for b in by[t] if a != b}
    assert expanded == pairs and all(r.members == len(by[r.name]) for r in classes)

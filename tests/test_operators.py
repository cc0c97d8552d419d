"""Rules at their boundaries, on rows written by hand."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import codes, identity as fid, shell, text as tx, vector as vec
from tidemark.operators import documents, encode, episodes, events as ev, facets, graph, identity as ident, runs, tags
from tidemark.plans import state
from tidemark.plans.components import components
from tidemark.sources import files, mail, messages, people, sessions
from tidemark.sources.base import sqlite
from tidemark import schemas

EVENT = "event_id string, ts long, channel string, thread_id string, direction string, content string"


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def ledger(spark, *events):
    return spark.createDataFrame([(e[0], e[1], "c", *e[2:]) for e in events], EVENT)


def test_gap_is_strict_and_null_threads_are_dropped(spark):
    df = ledger(spark, ("a", 0, "t", "sent", ""), ("b", 100, "t", "sent", ""), ("c", 201, "t", "sent", ""), ("d", 201, "t", "sent", ""), ("x", 5, None, "sent", ""), ("y", 9, "", "sent", ""))
    out = episodes.rows(episodes.time_gap(df, 100), "q")
    assert rows(out, "first_event_id", "event_count") == [("a", 2), ("c", 2), ("y", 1)]
    again = episodes.run_definition(df, {"name": "q", "strategy": "time_gap", "config": {"gap_seconds": 100}}, existing=episodes.time_gap(df, 100, definition="q"))
    assert again.count() == 0
    with pytest.raises(ValueError):
        episodes.run_definition(df, {"name": "q", "strategy": "other"})


def test_turn_pairs_drop_leading_answers(spark):
    df = ledger(spark, ("a", 1, "t", "received", ""), ("b", 2, "t", "sent", ""), ("c", 3, "t", "observed", ""), ("d", 4, "t", "received", ""), ("e", 5, "t", "sent", ""))
    assert rows(episodes.turn_pairs(df), "turn", "event_id", "position") == [(1, "b", 1), (1, "d", 2), (2, "e", 1)]
    assert rows(episodes.turn_pairs(df, include_tools=True), "turn", "event_id") == [(1, "b"), (1, "c"), (1, "d"), (2, "e")]
    assert rows(episodes.turn_pairs(df, existing=episodes.turn_pairs(df).where("turn = 1")), "event_id") == [("e",)]


def test_membership_flip_and_lines(spark):
    df = spark.createDataFrame([("a", 1, "t", "observed", "removed", True), ("b", 2, "t", "sent", None, False), ("c", 3, "t", "observed", "removed", True)], "event_id string, ts long, thread_id string, direction string, action string, is_self boolean")
    assert rows(episodes.membership_flip(df), "event_id", "action") == [("a", "added"), ("b", None), ("c", "removed")]
    lines = spark.createDataFrame([("Ann", "added", ["Bob", "Unknown"]), ("", "added", ["Bob"]), ("Bob", "removed", ["Bob"]), ("Ann", "removed", []), ("", "removed", []), ("Ann", "other", ["Bob"]), ("Ann", "other", None)], "actor string, action string, members array<string>")
    got = [r.l for r in lines.select(encode.membership_line(F.col("actor"), F.col("action"), F.col("members")).alias("l")).collect()]
    assert got == ["-> Ann added Bob", "-> Bob joined", "-> Bob left", "-> Ann removed a member", "-> member left", "-> membership update: Bob", None]


def test_episode_text(spark):
    df = spark.createDataFrame([("a", 0, "Ann", "hello", ["text"], None, None, ["[Image]"]), ("b", 60, "Bob", "👍", ["reaction"], "a", "hello", None), ("c", 61, None, None, ["text"], None, None, None)], "event_id string, ts long, name string, content string, content_types array<string>, reply_to string, original string, parts array<string>").withColumn("action", F.lit(None).cast("string")).withColumn("members", F.lit(None).cast("array<string>"))
    members = spark.createDataFrame([("e", "b", 2), ("e", "a", 1), ("e", "c", 3)], "episode_id string, event_id string, position int")
    assert encode.episode_texts(members, encode.event_lines(df)).first().text == 'Ann: hello [Image]\n[1970-01-01T00:01:00Z] -> Bob 👍 to "hello"\n'


def test_periods():
    assert ev.period("1970") == (0, 365 * 86400) and ev.period("1970-02") == (31 * 86400, 59 * 86400) and ev.period("1970-01-02", "Europe/Berlin") == (86400 - 3600, 2 * 86400 - 3600)
    assert ev.this_week(3 * 86400 + 5) == (-3 * 86400, 4 * 86400) and ev.today(86401) == (86400, 172800)
    with pytest.raises(ValueError):
        ev.period("70-1")


def test_filters_are_inclusive_and_directions_checked(spark):
    df = ledger(spark, *[(str(i), i, "t", "sent", None) for i in range(5)])
    assert rows(ev.query_events(df, ev.EventFilters(since=1, until=3)), "ts") == [(1,), (2,), (3,)]
    with pytest.raises(ValueError):
        ev.query_events(df, ev.EventFilters(direction="up"))


def test_merge_rules_and_null_keys(spark):
    old = spark.createDataFrame([("a", None, 1, "x"), ("b", "k", 5, "y")], "k string, k2 string, n int, v string")
    new = spark.createDataFrame([("a", None, 3, None), ("c", "k", 7, "z")], "k string, k2 string, n int, v string")
    out = state.merge_df(old, new, ["k", "k2"], {"n": "max"}, default="new_or_old")
    assert rows(out, "k", "n", "v") == [("a", 3, "x"), ("b", 5, "y"), ("c", 7, "z")]
    assert rows(state.merge_df(out, new, ["k", "k2"], {"n": "max"}, default="new_or_old"), "k", "n", "v") == rows(out, "k", "n", "v")
    assert rows(state.replace_for(old, new, ["k"]), "k", "n") == [("a", 3), ("b", 5), ("c", 7)]


def test_versioned_table(spark, tmp_path):
    t = state.VersionedTable(spark, f"file://{tmp_path}/t", schemas.TAGS)
    assert t.read().count() == 0
    for n in (1, 2):
        events = spark.createDataFrame([(str(i),) for i in range(n)], "event_id string")
        t.write(tags.add(t.read(), events, "topic", "x", 1))
        assert t.read().count() == n
    assert schemas.violations(t.read(), "tags").count() == 0
    with pytest.raises(ValueError):
        tags.add(t.read(), t.read(), "nonsense", "x", 1)


def test_components(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (7, 7), (None, 1)], "a long, b long")
    assert {r.node: r.component for r in components(df, "a", "b").collect()} == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100}


def test_identifiers_and_names(spark):
    df = spark.createDataFrame([("+1 (555) 123-4567", "phone"), (" Bob ", "handle"), ("@Bob", "handle"), (" A@X ", "email"), (" ", "email")], "v string, k string")
    assert [r.n for r in df.select(fid.identifier(F.col("v"), F.col("k")).alias("n")).collect()] == ["5551234567", "@bob", "@bob", "a@x", ""]
    names = spark.createDataFrame([("Ann Bell",), ("me",), ("a@x",), ("+1 555 123 4567",), ("@ann",), ("123",), (None,), ("!!",)], "n string")
    assert [(r.m, r.g) for r in names.select(fid.meaningful_name(F.col("n")).alias("m"), fid.generic_name(F.col("n")).alias("g")).collect()] == [(True, False)] + [(False, True)] * 6 + [(True, True)]
    pairs = spark.createDataFrame([("Tyler", "T", False), ("TYLER", "Tyler", False), ("Tyler", "TYLER", True), ("Tyler B", "Tyler", True), ("", "x", False), ("x", "", True)], "s string, t string, w boolean")
    assert all(r.g == r.w for r in pairs.select("w", fid.better_name(F.col("s"), F.col("t")).alias("g")).collect())


FACT = "person_id string, category string, fact_type string, fact_value string, confidence double, source_channel string"


def facts(spark, *fs):
    return spark.createDataFrame([(p, "c", t, v, c, None) for p, t, v, c in fs], FACT)


def test_collisions_normalize_and_drop_self_pairs(spark):
    df = facts(spark, ("a", "email_work", "X@y.z", 0.9), ("b", "email_work", "x@y.z", 0.7), ("a", "email_work", "x@Y.z", 0.9), ("c", "phone_home", "+1 (2)", 0.9))
    got = ident.tier1_collisions(df).collect()
    assert [(r.fact_value, r.person_ids, r.person_count) for r in got] == [("x@y.z", ["a", "b"], 2)]
    assert ident.tier1_collisions(df, parity=True).count() == 0


def test_suggestions_conflicts_and_merges(spark):
    df = facts(spark, ("a", "email_work", "e", 0.9), ("b", "email_work", "e", 0.9), ("c", "full_legal_name", "N", 0.5), ("d", "full_legal_name", "N", 0.5), ("c", "birthdate", "1", 1.0), ("d", "birthdate", "1", 1.0), ("a", "ssn", "1", 1.0), ("b", "ssn", "2", 1.0))
    found = ident.merge_suggestions(df)
    assert rows(found, "p1", "p2", "merge_type", "auto_eligible") == [("a", "b", "hard_identifier", True), ("c", "d", "hard_identifier", False)]
    mapping, review = ident.resolve_merges(found, df)
    assert rows(mapping, "person_id", "canonical_id") == [("c", "c"), ("d", "c")] and rows(review, "p1", "p2") == [("a", "b")]
    persons = spark.createDataFrame([(p, p.upper(), None, False, None) for p in "abcd"], schemas.PERSONS)
    links = spark.createDataFrame([("c", "k", 0.5, "s", 1, 2), ("d", "k", 0.9, "s", 0, 3)], schemas.LINKS)
    p, l, f = ident.merge_persons(persons, links, df, mapping)
    assert rows(p.where("canonical_name LIKE '%MERGED%'"), "person_id", "canonical_name") == [("d", "D [MERGED→c]")]
    assert rows(l, "person_id", "confidence", "first_seen_at", "last_seen_at") == [("c", 0.9, 0, 3)] and f.where("person_id = 'd'").count() == 0


def edges(spark, *es):
    return spark.createDataFrame([(i, s, t, lit, r, "f", v, inv, v or "", 1.0) for i, s, t, lit, r, v, inv in es], schemas.RELATIONSHIPS)


def test_contradictions(spark):
    df = edges(spark, ("1", "a", "x", None, "WORKS_AT", "2020", None), ("2", "a", "y", None, "WORKS_AT", "2021-05", None), ("3", "a", "z", None, "WORKS_AT", None, None), ("4", "a", "x", None, "KNOWS", "2019", None), ("5", "a", None, "P", "LIVES_IN", "2020", None), ("6", "a", None, "Q", "LIVES_IN", "2022", None), ("7", "b", "x", None, "WORKS_AT", "2020", "2020"))
    got = graph.contradictions(df, df)
    assert rows(got, "relationship_id", "invalid_at") == [("1", "2021-05"), ("3", "2020"), ("5", "2022")]
    assert graph.invalidate(df, got).where("invalid_at IS NULL").count() == 3
    assert rows(graph.contradictions_in_order(df), "relationship_id", "invalid_at") == [("1", "2021-05"), ("5", "2022")]


def test_traversal_as_of_and_merged_targets(spark):
    ents = spark.createDataFrame([("a", "A", 1, None, None, 1.0, None, "", ""), ("x", "X", 2, None, None, 1.0, None, "", ""), ("m", "M", 2, None, None, 1.0, "x", "", "")], schemas.ENTITIES)
    df = edges(spark, ("1", "a", "x", None, "R", "2020", "2021"), ("2", "a", "m", None, "R", None, None), ("3", "a", None, "lit", "R", None, None))
    start = spark.createDataFrame([("a",)], "start_id string")
    assert rows(graph.related(ents, df, start, graph.QueryOptions(as_of="2020-06")), "relationship_id") == [("1",)]
    assert rows(graph.related(ents, df, start, graph.QueryOptions(now="2022")), "relationship_id") == []
    assert rows(graph.entity_relationships(ents, df, start, graph.QueryOptions(include_invalidated=True)), "relationship_id", "other_name") == [("1", "X"), ("2", None), ("3", None)]


def test_promotion_sharing_and_edges(spark):
    aliases = spark.createDataFrame([("x", "a@b", "email", "a@b", False, "")], schemas.ALIASES)
    new = spark.createDataFrame([("a", None, "A@b ", "HAS_EMAIL", "f", "self_disclosed", "e1", None, 1.0), ("a", None, "12", "HAS_PHONE", "f", "self_disclosed", "e1", None, 1.0), ("b", None, "q@r", "HAS_EMAIL", "f", "mentioned", "e1", None, 1.0), ("a", "b", None, "KNOWS", "f", "mentioned", "e1", None, 1.0), ("a", "b", None, "KNOWS", "f", "mentioned", "e2", None, 1.0), ("a", "b", None, "KNOWS", "f", "mentioned", "e2", "2020", 1.0)], "source_entity_id string, target_entity_id string, target_literal string, relation_type string, fact string, source_type string, episode_id string, valid_at string, confidence double")
    after, mentions, rest = graph.promote_identities(new, aliases, "now")
    assert rows(after, "entity_id", "normalized", "is_shared") == [("a", "a@b", True), ("x", "a@b", True)]
    assert rows(mentions, "target_literal") == [("A@b ",), ("q@r",)]
    none = spark.createDataFrame([], schemas.RELATIONSHIPS)
    state_, said = graph.resolve_edges(none, rest, "now")
    assert state_.count() == 2 and said.count() == 3
    assert graph.resolve_edges(state_, rest, "later")[0].count() == 2


def test_entity_merge(spark):
    ents = spark.createDataFrame([("a", "ANN", 1, None, None, 1.0, None, "", ""), ("b", "Ann Bell", 1, None, None, 1.0, None, "", "")], schemas.ENTITIES)
    al = spark.createDataFrame([("b", "m", "email", "m", False, "")], schemas.ALIASES)
    men = spark.createDataFrame([("e", "a", 2, "1"), ("e", "b", 3, "0")], schemas.ENTITY_MENTIONS)
    mapping = graph.merge_mapping(spark.createDataFrame([("a", "b")], "entity_a_id string, entity_b_id string"))
    e, a, r, m = graph.merge_entities(ents, al, edges(spark, ("1", "b", "z", None, "R", None, None), ("2", "a", "b", None, "R", None, None)), men, mapping, "now")
    assert rows(e, "entity_id", "canonical_name", "merged_into") == [("a", "Ann Bell", None), ("b", "Ann Bell", "a")]
    assert rows(a, "entity_id") == [("a",)] and rows(r, "source_entity_id") == [("a",)] and rows(m, "entity_id", "mention_count", "created_at") == [("a", 5, "0")]


def test_text_and_vectors(spark):
    assert tx.split_terms("A bc, de/f.gh") == ["bc", "de", "gh"]
    assert [tx.stem(w) for w in "running dogs caresses ponies relational hopping falling generalization sky happy".split()] == ["run", "dog", "caress", "poni", "relat", "hop", "fall", "gener", "sky", "happi"]
    df = spark.createDataFrame([("Aaaa", [1.0, 0.0]), (None, [0.0, 0.0])], "t string, v array<double>")
    got = df.select(tx.lexical_score(F.col("t"), F.col("t"), F.lit("aa"), "aa").alias("s"), vec.query_cosine(F.col("v"), [1.0, 0.0]).alias("c"), vec.from_blob(vec.to_blob(F.col("v"))).alias("b")).collect()
    assert [(r.s, r.c, r.b) for r in got] == [(11.0, 1.0, [1.0, 0.0]), (1.0, 0.0, [0.0, 0.0])]
    strip = spark.createDataFrame([("a<thinking>x</thinking>\n\n\n\nb<tool_calls>q</tool_results> ",)], "t string").select(tx.strip_tool_and_thinking(F.col("t")).alias("s")).first().s
    assert strip == "a\n\nb"


def test_shell():
    got = [tuple(i) for i in shell.invocations("sudo -n X=1 'my tool' a \"b c\" d 2>&1 | cargo run -p cli -- sync now; pnpm dlx -y Eslint . && npm test & ''", {"cli": "own"})]
    assert [(g[0], g[1], g[2], g[3]) for g in got] == [("my tool", "a", "b c d 2>&1", "direct"), ("own", "sync", "now", "cargo_run"), ("eslint", ".", None, "wrapper:pnpm"), ("npm", "test", None, "direct")]


def test_facts_of_extractions(spark):
    out = '{"facts":[{"subject_kind":"user","category":"c","fact_type":"date_of_birth","value":"1","confidence":"high"},{"subject_kind":"third_party","subject_ref":"Zed","category":"c","fact_type":"email_work","value":"z@z"},{"subject_kind":"third_party","subject_ref":"Yan","category":"c","fact_type":"nicknames","value":"yy"},{"subject_kind":"","subject_ref":"bob","category":"c","fact_type":"profession","value":"p","confidence":"low","self_disclosed":true}],"unattributed_facts":[{"fact_type":"t","fact_value":"v","shared_by":"Bob"}]}'
    runs_ = spark.createDataFrame([("r", "e", "chat", out)], "run_id string, episode_id string, channel string, output_text string")
    who = spark.createDataFrame([("e", "me", "Me Self", None, True), ("e", "bob", "Bob Bell", None, False)], "episode_id string, person_id string, canonical_name string, display_name string, is_me boolean")
    got = facets.process_extractions(runs_, who, spark.createDataFrame([], "normalized string, person_id string"))
    assert rows(got["facts"], "person_id", "fact_type", "confidence", "source_type") == [("bob", "profession", 0.4, "self_disclosed"), ("me", "birthdate", 0.9, "mentioned")]
    assert rows(got["third_parties"], "canonical_name") == [("Zed",)] and rows(got["mentions"], "reference", "known_facts") == [("Yan", '{"nickname":"yy"}')]
    assert rows(got["unattributed"], "shared_by_person_id", "fact_value") == [("bob", "v")]


def test_document_versions_and_retrieval(spark):
    df = spark.createDataFrame([("d", "c", "t", "", "one", 1), ("d", "c", "t", "", "one", 2), ("d", "c", "t", "", "two", 3)], "doc_key string, channel string, title string, description string, content string, ts long")
    none = spark.createDataFrame([], schemas.DOCUMENT_HEADS)
    heads, new = documents.upsert(none, df)
    assert rows(new, "ts", "action") == [(1, "created"), (3, "updated")] and heads.count() == 1
    again, more = documents.upsert(heads, df.where("ts = 3"))
    assert more.count() == 0 and rows(again, "content_hash") == rows(heads, "content_hash")
    counted, log = documents.track_retrieval(heads, heads.select("doc_key", F.lit(1.0).alias("score")), "q", 9)
    assert rows(counted, "retrieval_count", "last_retrieved_at") == [(1, 9)] and log.first().retrieval_id == "d:9"


def test_not_in_trap(spark):
    a, b = spark.createDataFrame([(1,), (2,), (None,)], "x int"), spark.createDataFrame([(1,), (None,)], "y int")
    assert documents.not_in(a, "x", b, "y").count() == 0
    assert rows(documents.not_in(a, "x", b.where("y = 1"), "y"), "x") == [(2,)] and documents.not_in(a, "x", b.limit(0), "y").count() == 3


def test_sources(spark, tmp_path):
    (tmp_path / "m.mbox").write_text("From a\nDate: Mon, 01 Jan 2024 00:00:00 +0000\nFrom: =?utf-8?q?J=C3=BCrg?= <J@X.org>\nTo: me@x.org, B <b@x.org>\nSubject: =?utf-8?q?H=C3=AD?=\nX-GM-MSGID: 1\nX-GM-THRID: 9\nX-GM-LABELS: Inbox,Unread\n\nbody\n>From quoted\n\nFrom b\nDate: Tue, 02 Jan 2024 00:00:00 +0000\nFrom: me@x.org\nTo: j@x.org\nMessage-ID: <2>\nX-GM-THRID: 9\n\nanswer\n")
    got = mail.mbox_events(mail.read_mbox(spark, f"{tmp_path}/m.mbox"), "me@x.org")
    assert rows(got, "ts", "direction", "thread_id", "content") == [(1704067200, "received", "gmail:9", "Subject: Hí\n\nbody\nFrom quoted"), (1704153600, "sent", "gmail:9", "answer")]
    assert rows(mail.participants(got), "role", "email", "name")[:1] == [("recipient", "b@x.org", "B")]
    assert rows(mail.state(got), "read_state", "archived", "status") == [("unknown", True, "sent"), ("unread", False, "received")]
    (tmp_path / "log.jsonl").write_text('{"id":"1","timestamp_ms":1999,"source":"My-Agent","content":"x"}\nnot json\n{"id":"2","ts":"1970-01-01T00:00:05Z","payload":"y"}\n')
    assert rows(files.log_events(files.read_log(spark, str(tmp_path))), "source_id", "ts", "channel") == [("1", 1, "agent"), ("2", 5, "terminal")]
    with pytest.raises(PermissionError):
        files.raw_sql(spark, "/* x */ CREATE TABLE t AS SELECT 1")
    assert files.raw_sql(spark, "WITH a AS (SELECT 1 AS x) SELECT * FROM a").count() == 1
    post = spark.createDataFrame([("Wed Oct 10 20:19:24 +0000 2018",)], "c string").select(people.post_seconds(F.col("c")).alias("s")).first().s
    assert post == 1539202764


def test_sessions(spark):
    msgs = spark.createDataFrame([("m1", "s", "user", "q1", 1, 1000, None), ("m2", "s", "user", " q2 ", 0, 1500, None), ("m3", "s", "assistant", "<thinking>t</thinking>answer", 2, 2999, '{"toolFormerData":{"name":"run_terminal_cmd","params":"{\\"command\\":\\"ls -l\\"}","status":"completed"}}')], schemas.MESSAGES)
    turns = spark.createDataFrame([("t", "s", None, '["m1","m2"]', "m3", None, 0, 3000, 0, 0)], schemas.TURNS)
    assert rows(sessions.turn_events(turns, msgs, "x"), "source_id", "direction", "content", "ts") == [("t:assistant", "received", "answer", 3), ("t:user", "sent", "q2\n\nq1", 3)]
    assert rows(sessions.tool_commands(msgs, "x"), "content", "source_adapter", "ts") == [("ls -l", "x_tool", 2)]


def test_messages_and_sqlite(spark, tmp_path):
    import sqlite3

    with sqlite3.connect(tmp_path / "s.db") as db:
        db.execute("CREATE TABLE r (guid TEXT, reaction_type INTEGER)")
        db.executemany("INSERT INTO r VALUES (?, ?)", [(f"g{i}", 2000 + i) for i in range(8)])
    df = sqlite(spark, str(tmp_path / "s.db"), "r", "guid string, reaction_type int", 3)
    assert df.count() == 8 and rows(df.select("guid", codes.reaction(F.col("reaction_type")).alias("e")).where("guid >= 'g5'"), "e") == [("reaction:2006",), ("reaction:2007",), ("❓",)]
    raw = spark.createDataFrame([(1, "g", 7, None, "hi", 5, 1, "", 0)], "id long, guid string, chat_id long, sender_id long, content string, timestamp long, is_from_me int, reply_to_guid string, is_group int").drop("is_group")
    chats = spark.createDataFrame([(7, "+15551234567", None, 0)], "id long, chat_identifier string, chat_name string, is_group int")
    files_ = spark.createDataFrame([(1, "a")], "message_id long, guid string")
    got = messages.messages(raw, chats, files_).first()
    assert (got.event_id, got.content_types, got.direction, got.thread_id, got.reply_to) == ("imessage:g", ["text", "attachment"], "sent", "imessage:chat_id:7", None)
    assert messages.messages(raw, chats, files_, since=5).count() == 0


def test_runs(spark):
    log = spark.createDataFrame([("t", "1", "running", 1), ("t", "1", "completed", 2), ("t", "2", "failed", 1), ("t", "3", "blocked", 1)], "analysis_type string, episode_id string, status string, ts long")
    eps = spark.createDataFrame([(str(i),) for i in range(1, 5)], "episode_id string")
    assert rows(runs.work_list(eps, "t", log), "episode_id") == [("2",), ("4",)]


def test_entities_of_large_groups_collide_all(spark):
    n = 60
    ents = spark.createDataFrame([(f"e{i:02}", None) for i in range(n)], "entity_id string, merged_into string")
    names = [(f"e{i:02}", "name", "ann", False) for i in range(n)]
    mails = [(f"e{i:02}", "email", "office@x.org", False) for i in range(n)]
    al = spark.createDataFrame(names + mails, "entity_id string, alias_type string, normalized string, is_shared boolean")
    rel = spark.createDataFrame([(f"e{i:02}", None, "Acme", "WORKS_AT", None) for i in range(n)], "source_entity_id string, target_entity_id string, target_literal string, relation_type string, invalid_at string")
    got = graph.entity_collisions(ents, al, rel).collect()
    assert {(r.entity_a_id, r.entity_b_id) for r in got} == {(f"e{i:02}", f"e{j:02}") for i in range(n) for j in range(i + 1, n)}
    assert len(got) == n * (n - 1) // 2 and {r.reason for r in got} == {"hard_identifier"}
    compound = graph.entity_collisions(ents, al.where("alias_type = 'name'"), rel).collect()
    assert len(compound) == n * (n - 1) // 2 and {r.compound_type for r in compound} == {"name_employer"}

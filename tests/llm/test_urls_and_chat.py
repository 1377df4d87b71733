"""URL rules and tool-call linking against plain Python."""

import json
from collections import Counter
from itertools import combinations, product

from pagewright.llm import chat, urls

RULES = sorted(urls.BASE_RULES, key=lambda r: -len(r[0] + r[1]))


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    end = next((i for i, c in enumerate(path) if c in "?#"), len(path))
    return host, path[:end]


def base_rule(host, path):
    for h, p, verdict in RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            return h + p, verdict
    return None, None


URLS = [
    None, "", "no scheme", "http://", "http://x.com/en/1", "HTTP://A.EXAMPLE.com/en/7x?y#z", "https://example.net/de/8#", "https://b.example.net/de/9", "https://net/de/", "https://fish.org/es/?a://b",
    "x://y.com?en/", "ftp://example.comet/en/", "http://É.com/en/\nnew", "http://spam-win.example.org/fr/5", "http://a.b/c://d/e", "http://evilnet/de/1",
]


def test_base_rules(spark):
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)] + [(None, URLS[4], "h"), (4, URLS[4], "h")], "page_id long, url string, host string")
    none = urls.mined_rules(spark.createDataFrame([], "url string, blocked boolean"))
    found = urls.judge(pages, none).collect()
    assert len(found) == len(URLS) + 2
    for r in found:
        if r["page_id"] is None:
            continue
        host, path = parts(URLS[r["page_id"]])
        rule, verdict = base_rule(host, path)
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict or "allow")
    assert urls.judge(pages.limit(0), none).count() == 0


def test_mined_rules_reach_support_and_confidence(spark):
    rows = [(f"http://h{i % 9}.site{i % 4}.org/{'casino' if i % 3 == 0 else 'news'}/{i}?ref={i}", i % 3 == 0 or i % 50 == 1) for i in range(300)]
    labelled = spark.createDataFrame([*rows, (None, True), ("http://x.org/casino", None)], "url string, blocked boolean")
    mined = urls.mined_rules(labelled, support=0.05, confidence=0.8)
    rules = mined.rules.collect()
    classes = {r["token"]: r["class"] for r in mined.classes.collect()}
    tokens = [{classes.get(t) for t in r["t"]} for r in labelled.where("url is not null and blocked is not null").select(urls.tokens_of(labelled["url"]).alias("t")).collect()]
    blocked = [b for _, b in rows]
    assert rules
    for rule in rules:
        need = set(rule["tokens"])
        hits = [b for t, b in zip(tokens, blocked, strict=True) if need <= t]
        assert abs(sum(hits) / len(hits) - rule["confidence"]) < 1e-9 and rule["confidence"] >= 0.8
        assert abs(sum(hits) / len(rows) - rule["support"]) < 1e-9 and rule["support"] >= 0.05
        assert not any(set(o["tokens"]) < need for o in rules)
    judged = urls.judge(spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "page_id long, url string"), mined).collect()
    for r in judged:
        met = [set(o["tokens"]) <= tokens[r["page_id"]] for o in rules]
        assert r["n_rules"] == sum(met) and r["verdict"] == ("block" if any(met) else "allow")


def brute_rules(spark, labelled, least=5, confidence=0.8):
    every, bad = Counter(), Counter()
    for r in labelled.select(urls.tokens_of(labelled["url"]).alias("t"), "blocked").collect():
        for k in range(1, len(r["t"]) + 1):
            for part in combinations(sorted(r["t"]), k):
                every[part] += 1
                bad[part] += r["blocked"]
    held = {frozenset(p): n / every[p] for p, n in bad.items() if n >= least and n / every[p] >= confidence}
    return {p: round(c, 9) for p, c in held.items() if not any(frozenset(q) in held for k in range(1, len(p)) for q in combinations(p, k))}


def on_tokens(mined):
    """The mined rules on classes as rules on tokens."""
    members = {}
    for r in mined.classes.collect():
        members.setdefault(r["class"], []).append(r["token"])
    return {frozenset(p): round(r["confidence"], 9) for r in mined.rules.collect() for p in product(*(members[c] for c in r["tokens"]))}


def test_mined_rules_are_complete_with_a_hot_clean_host(spark):
    rows = [(f"http://hot.org/{'promo' if i < 17 else 'news'}/{i}", i < 17) for i in range(333)]
    rows += [(f"http://h{i % 10}.net/promo/{i}", i < 30) for i in range(100)]
    rows += [(f"http://h{i % 7}.com/{'casino' if i < 153 else 'text'}/{i}", i < 153) for i in range(567)]
    labelled = spark.createDataFrame(rows, "url string, blocked boolean")
    found = urls.mined_rules(labelled)
    assert on_tokens(found) == brute_rules(spark, labelled)
    assert frozenset({"d:hot", "p:promo"}) in on_tokens(found)
    page = spark.createDataFrame([(1, "http://hot.org/promo/900"), (2, "http://hot.org/news/900")], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in urls.judge(page, found).collect()} == {1: "block", 2: "allow"}


def test_mined_rules_of_random_urls_are_complete(spark):
    import random

    rng = random.Random(12)
    words = ["win", "free", "cash", "blog", "shop"]
    for share in (0.3, 0.95):
        rows = []
        for _ in range(240):
            host, path = rng.choice(words), rng.sample(words, rng.randrange(0, 4))
            bad = rng.random() < (share if {"win", "cash"} & set(path) else 0.1 if share < 0.5 else share)
            rows.append((f"http://{host}.{rng.choice(['com', 'net'])}/{'/'.join(path)}", bad))
        labelled = spark.createDataFrame(rows, "url string, blocked boolean")
        assert on_tokens(urls.mined_rules(labelled)) == brute_rules(spark, labelled)


def test_a_rule_on_a_class_holds_for_each_of_its_tokens(spark):
    rows = [(f"http://spam.org/win/{k}", True) for k in range(9)] + [(f"http://fine.org/{k}", False) for k in range(9)]
    mined = urls.mined_rules(spark.createDataFrame(rows, "url string, blocked boolean"))
    pages = spark.createDataFrame([(1, "http://x.net/win"), (2, "http://a-spam.net/"), (3, "http://fine.org/3"), (4, None)], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in urls.judge(pages, mined).collect()} == {1: "block", 2: "block", 3: "allow", 4: "allow"}


def test_long_segments_stay_apart(spark):
    long = "a" * 64
    found = spark.createDataFrame([(f"http://x.org/{long}b/{long}c/{long}",)], "url string")
    tokens = found.select(urls.tokens_of(found["url"]).alias("t")).first()["t"]
    assert {f"p:{long}b", f"p:{long}c", f"p:{long}"} <= set(tokens)


SCHEMAS = [("add", "a", "integer", True), ("add", "b", "number", True), ("add", "note", "string", False), ("ping", None, None, None)]


def test_links_levels_errors_and_json(spark):
    calls = [
        (1, "c1", "add", '{"b": 2.5, "a": 1}', 1, 0), (1, "c2", "add", '{"a": {"$ref": "c1"}, "b": 1}', 1, 1), (1, "c3", "ping", '{"x": {"$ref":"c2"}, "y": {"$ref":"c1"}}', 3, 0),
        (1, "c1", "ping", "{}", 5, 0), (2, "c1", "nope", "{}", 1, 0), (2, "p", "ping", "not json", 1, 1), (2, "q", "add", '{"a": "1", "b": null}', 2, 0), (2, "r", "ping", None, 2, 1),
        (3, "x", "ping", '{"z": {"$ref":"y"}}', 1, 0), (3, "y", "ping", '{"z": {"$ref":"x"}}', 1, 1), (3, "w", "ping", '{"z": {"$ref":"lost"}}', 1, 2), (3, "v", "ping", '{"z": {"$ref":"x"}}', 1, 3),
        (None, "c", "ping", "{}", 1, 0), (4, None, "ping", "{}", 1, 0),
    ]
    results = [(1, "c1", "first", 2), (1, "c1", "second", 4), (1, "zz", "orphan", 2), (2, "q", None, 3), (None, "c1", "x", 1)]
    c, r = spark.createDataFrame(calls, chat.CALL), spark.createDataFrame(results, chat.RESULT)
    found = {(x["conv_id"], x["call_id"], x["turn"], x["position"]): x for x in chat.linked_calls(c, r, spark.createDataFrame(SCHEMAS, "name string, argument string, kind string, required boolean")).collect()}
    assert len(found) == 14 and found[4, None, 1, 0]['errors'] == found[None, 'c', 1, 0]['errors'] == ['no id']
    get = lambda *k: found[k]
    assert (get(1, "c1", 1, 0)["level"], get(1, "c2", 1, 1)["level"], get(1, "c3", 3, 0)["level"]) == (0, 1, 2)
    assert get(1, "c1", 1, 0)["json"] == '{"arguments":{"a":1,"b":2.5},"id":"c1","name":"add","result":{"content":"first","turn":2},"turn":1}'
    assert get(1, "c1", 1, 0)["errors"] == [] and get(1, "c1", 5, 0)["errors"] == ["duplicate id"] and get(1, "c1", 5, 0)["result_turn"] is None
    assert get(1, "c2", 1, 1)["errors"] == ["type of a"] and get(1, "c3", 3, 0)["errors"] == ["unexpected x", "unexpected y"]
    assert get(2, "c1", 1, 0)["errors"] == ["unknown tool"] and get(2, "p", 1, 1)["errors"] == ["invalid arguments"] and get(2, "r", 2, 1)["errors"] == ["invalid arguments"]
    assert get(2, "q", 2, 0)["errors"] == ["type of a", "type of b"] and get(2, "q", 2, 0)["result_turn"] == 3
    assert get(3, "x", 1, 0)["level"] is None and "cycle" in get(3, "y", 1, 1)["errors"] and "cycle" in get(3, "v", 1, 3)["errors"]
    assert "unknown reference" in get(3, "w", 1, 2)["errors"] and get(3, "w", 1, 2)["level"] == 0
    assert all(json.loads(x["json"]) for x in found.values())
    assert sorted((x["conv_id"] or 0, x["call_id"]) for x in chat.orphans(c, r).collect()) == [(0, "c1"), (1, "zz")]
    assert chat.linked_calls(c.limit(0), r, spark.createDataFrame(SCHEMAS, "name string, argument string, kind string, required boolean")).count() == 0


def test_ties_and_null_turns(spark):
    calls = [
        (1, "a", "ping", '{"z": 1}', 2, 0), (1, "a", "ping", "{}", 2, 0), (1, "a", "ping", "{}", None, 0), (1, "b", "ping", "{}", None, None), (1, "b", "ping", "{}", None, None),
        (2, "c", "ping", "{}", 0, None), (2, "c", "ping", "{}", 0, 3),
    ]
    results = [(1, "a", "late", None), (1, "a", "second", 3), (1, "a", "first", 3), (1, "b", None, None)]
    c, r = spark.createDataFrame(calls, chat.CALL), spark.createDataFrame(results, chat.RESULT)
    found = chat.linked_calls(c, r, spark.createDataFrame([("ping", None, None, None)], "name string, argument string, kind string, required boolean")).collect()
    assert len(found) == len(calls)
    firsts = {(x["conv_id"], x["call_id"]): x for x in found if x["level"] is not None}
    assert sorted(firsts) == [(1, "a"), (1, "b"), (2, "c")] and all(x["level"] == 0 for x in firsts.values())
    assert sum("duplicate id" in x["errors"] for x in found) == 4
    assert (firsts[1, "a"]["turn"], firsts[1, "a"]["result_turn"]) == (2, 3) and '"content":"first"' in firsts[1, "a"]["json"] and '"arguments":{"z":1},' in firsts[1, "a"]["json"]  # the smaller text
    assert firsts[1, "b"]["turn"] is None and '"result":{}' in firsts[1, "b"]["json"] and firsts[2, "c"]["position"] == 3


def test_query_on_conversations_with_tool_calls(spark, tmp_path):
    from pagewright.llm import queries

    talk = json.dumps({"tool_calls": [{"id": "t1", "name": "reply", "arguments": {"turn": 1, "text": "x"}}, {"id": "t2", "name": "find", "arguments": {"q": {"$ref": "t1"}}}]})
    rows = [
        (1, 0, "system", "rules"), (1, 1, "user", "hi"), (1, 2, "assistant", talk), (1, 3, "tool", '{"tool_call_id": "t1", "content": "done"}'), (1, 4, "tool", "broken"),
        (1, 5, "assistant", "bye"), (1, 6, None, "odd"), (2, None, "user", "lost"),
    ]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    found = [r.asDict() for r in queries.op6_chat_formatting(spark, str(tmp_path)).collect()]
    by_kind = Counter(r["kind"] for r in found)
    assert by_kind == {"call": 4, "orphan": 2, "message": 2}
    calls = {r["call_id"]: r for r in found if r["kind"] == "call"}
    assert (calls["1:1"]["result_turn"], calls["t1"]["result_turn"], calls["t2"]["level"], calls["t2"]["errors"]) == (2, 3, 1, "unknown tool")
    assert calls["t1"]["json"] == '{"arguments":{"text":"x","turn":1},"id":"t1","name":"reply","result":{"content":"done","turn":3},"turn":2}'
    assert calls[None]["errors"] == "missing turn,no id"
    assert sorted((r["turn"], r["call_id"] or "") for r in found if r["kind"] == "orphan") == [(4, ""), (5, "1:4")]
    assert {r["json"] for r in found if r["kind"] == "message"} == {'{"content":"rules","role":"system","turn":0}', '{"content":"odd","turn":6}'}


def test_embedded_calls(spark):
    rows = [
        (1, 0, "user", "hi", 0), (1, 1, "assistant", '{"tool_calls": [{"id": "a", "name": "ping", "arguments": {"k": [1, 2]}}, {"id": "b", "name": "ping", "arguments": {}}]}', 0),
        (1, 2, "tool", '{"tool_call_id": "a", "content": "ok"}', 0), (1, 3, "assistant", "{broken", 0), (1, 4, "assistant", None, 0), (1, 5, "tool", "plain", 0),
    ]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, call_id int")
    calls = sorted((r["call_id"], r["name"], r["arguments"], r["turn"], r["position"]) for r in chat.embedded_calls(messages).collect())
    assert calls == [("a", "ping", '{"k":[1,2]}', 1, 0), ("b", "ping", "{}", 1, 1)]
    assert [(r["call_id"], r["content"]) for r in chat.embedded_results(messages).where("call_id is not null").collect()] == [("a", "ok")]
    assert chat.exchange_calls(messages).count() == 1 and chat.exchange_results(messages).count() == 3


def test_levels_of_graphs(spark):
    import random

    rng = random.Random(8)
    edges = [(f"c{i}", f"c{i - 1}") for i in range(1, 70)] + [("m", "c5"), ("m", "c40"), ("m2", "m"), ("top", "m2"), ("top", "c69"), ("k1", "k2"), ("k2", "k3"), ("k3", "k1"), ("above", "k1"), ("both", "k1"), ("both", "c1")]
    edges += [(f"r{i}", f"r{rng.randrange(i)}") for i in range(1, 40) for _ in range(rng.choice([1, 1, 2, 3]))]
    nodes = sorted({x for e in edges for x in e} | {"alone"})
    below = {n: {b for a, b in edges if a == n} for n in nodes}

    def level(n, path=()):
        if n in path:
            return None
        found = [level(b, (*path, n)) for b in below[n]]
        return None if None in found else max((f + 1 for f in found), default=0)

    df = spark.createDataFrame([(n,) for n in nodes], "node string")
    found = {r["node"]: r["level"] for r in chat.levels(df, spark.createDataFrame(edges, "node string, needs string")).collect()}
    assert found == {n: level(n) for n in nodes}

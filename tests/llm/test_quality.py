import re

from ledgerlens.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    seen = {}
    for i in range(len(w) - 4):
        seen.setdefault(tuple(w[i: i + 5]), []).append(i)
    covered = {i + j for at in seen.values() if len(at) > 1 for i in at for j in range(5)}
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in t),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_lines": len(lines),
            "n_upper": sum("A" <= c <= "Z" for c in t), "n_stutter": sum(a == b for a, b in zip(w, w[1:]))}


def test_measures_match_brute_force(edges, edge_rows):
    got = sorted((tuple(getattr(r, c) for c in brute("")) for r in Q.ledger(edges).collect()))
    assert got == sorted(tuple(brute(t).values()) for _, t in edge_rows)


def test_policy_and_kept_rows_agree(spark, edges):
    rows = Q.apply_policy(Q.ledger(edges))
    kept = Q.keep_passing(edges)
    assert kept.columns == edges.columns
    assert kept.count() == rows.filter("kept").count() > 0
    assert rows.filter("base_failed and kept").count() == 0
    junk = spark.createDataFrame([(1, "| a | b | c | d | e | f | g | h | i | j"), (2, "Re Re Re Re no no no no so so so so"),
                                  (3, "a clean text of some words that nobody would want to lose at all")], "doc_id long, text string")
    assert [r.doc_id for r in Q.keep_passing(junk).collect()] == [3]


def test_ablation_counts_from_masks(edges):
    led = Q.ledger(edges).collect()
    for r in Q.ablation(Q.ledger(edges)).collect():
        pm, rb = Q.policy_mask(r.policy), Q.bit(r.rule)
        assert r.n_failed == sum(x.fail_mask & rb != 0 for x in led)
        assert r.n_only_this_rule == sum(x.fail_mask & pm == rb for x in led)
        assert r.n_kept == sum(x.fail_mask & pm == 0 for x in led)


def test_empty_table(nothing):
    assert Q.apply_policy(Q.ledger(nothing)).count() == 0 and Q.keep_passing(nothing).count() == 0
    assert Q.ablation(Q.ledger(nothing)).count() == 0


def test_main_path_is_native(edges):
    plan = Q.keep_passing(edges)._jdf.queryExecution().toString() + Q.ledger(edges)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)

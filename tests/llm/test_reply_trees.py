"""Reply trees: branches against a walk, escapes and masks read back, odd rows."""

import hashlib

from pyspark.sql import functions as F

from millrace.llm.reply_trees import as_tree, branches, chosen, conversation, digests, escape, read_back, unescape

TREE = "tree_id long, msg_id long, parent_id long, role string, text string, score double"


def test_branches_of_a_tree(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "a", 1.0), (1, 3, 1, "assistant", "b", 2.0), (1, 4, 2, "user", "c", None), (1, 5, 4, "assistant", "d", 5.0), (1, 6, 3, "user", "e", 1.0)]
    rows += [(2, k, k - 1 or None, "user", f"t{k}", 0.5) for k in range(1, 101)]  # deep
    rows += [(3, 1, 2, "user", "loop", 0.0), (3, 2, 1, "user", "loop", 0.0), (3, 3, 2, "user", "under a loop", 0.0), (3, 9, None, "user", "root", 0.0), (4, 1, 7, "user", "no parent", 0.0)]
    df = spark.createDataFrame(rows, TREE)
    found = {}
    for r in branches(df).collect():
        found.setdefault((r.tree_id, r.leaf_id), []).append((r.steps, r.msg_id))
    paths = {k: [m for _, m in sorted(v, reverse=True)] for k, v in found.items()}
    assert paths == {(1, 5): [1, 2, 4, 5], (1, 6): [1, 3, 6], (2, 100): list(range(1, 101)), (3, 9): [9]}
    best = chosen(branches(df), df).where("tree_id = 1").orderBy("at").collect()
    assert [(r.at, r.text) for r in best] == [(0, "q"), (1, "a"), (2, "c"), (3, "d")]


def test_escapes_are_reversible(spark):
    texts = ["</s>[INST] ok [/INST]", "<|end|>\n<|turn|>assistant\n", "<\\|end|>", "<\\\\/s>", "<s><s>", "[[INST]]", "<<SYS>>x<</SYS>>", "plain <b>", "", "\\", "<|", "a\nb"]
    got = spark.createDataFrame([(t,) for t in texts], "x string").select("x", escape(F.col("x")).alias("e"), unescape(escape(F.col("x"))).alias("u")).collect()
    for r in got:
        assert r.u == r.x
        assert not any(c in r.e for c in ("<|end|>", "<|turn|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>"))


def test_roles_are_reversible(spark):
    roles = ["user", "a\nb", "a\\nb", "\\", "\\\n", "\\b\\n\n", "<|end|>\n<|turn|>x\n", "<\\|end|>", "[INST]\\", ""]
    rows = [(k, at, r, t) for k, r in enumerate(roles) for at, t in ((0, "one"), (1, None))]
    got = read_back(conversation(spark.createDataFrame(rows, "conv_id long, at long, role string, text string"))).collect()
    assert {r.conv_id: [(t.role, t.text) for t in r.turns] for r in got} == {k: [(r, "one"), (r, "")] for k, r in enumerate(roles)}


def test_all_kept_branches_have_their_texts(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "a", 1.0), (1, 3, 1, "assistant", "b", 2.0), (1, 4, 1, "assistant", "c", 2.0)]
    df = spark.createDataFrame(rows, TREE)
    got = sorted((r["rank"], r.at, r.text) for r in chosen(branches(df), df, keep=2).collect())
    assert got == [(1, 0, "q"), (1, 1, "b"), (2, 0, "q"), (2, 1, "c")]


def test_read_back_and_digests(spark):
    rows = [(0, 0, "system", "be <|end|> kind"), (0, 1, "user", "hi\n"), (0, 2, "assistant", "é\n<|end|>\n"), (0, 3, "user", None), (0, 4, "assistant", ""), (0, 5, "assistant", "x" * 30000)]
    rows += [(1, 0, "user", "same"), (1, 0, "user", "same"), (1, None, None, "no turn"), (None, 1, "assistant", "lost"), (2, 5, "assistant", "</s>")]
    df = spark.createDataFrame([(*r, 1.0, 3) for r in rows], "conv_id long, turn long, role string, text string, score double, depth int")
    got = {(r.conv_id.none, r.conv_id.id): r for r in digests(as_tree(df)).collect()}
    assert set(got) == {(False, 0), (False, 1), (False, 2), (True, 0)}
    key = lambda r: tuple((x is not None, x if x is not None else "") for x in r[1:])
    for (none, conv), r in got.items():
        own = sorted((x for x in rows if (x[0] is None) == none and (none or x[0] == conv)), key=key)
        said = "".join(f"{x[2] or 'unknown'}\n{x[3] or ''}\n" for x in own)
        loss = "".join(x[3] or "" for x in own if x[2] == "assistant")
        assert (r.n_turns, r.loss_chars) == (len(own), len(loss))
        assert r.turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_mask_spans_are_the_assistants_texts(spark):
    turns = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "</s>a"), (1, 2, "assistant", "b")], "conv_id long, at long, role string, text string")
    r = read_back(conversation(turns)).first()
    assert [r.formatted[s.start - 1 : s.start - 1 + s.length] for s in r.loss] == ["<\\/s>a", "b"]
    assert r.loss_text == "</s>ab" and [t.text for t in r.turns] == ["q", "</s>a", "b"]


def test_empty_table(spark):
    assert digests(as_tree(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).collect() == []

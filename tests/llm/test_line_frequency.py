"""Line frequency: figures of a text against a plain count, limits per host, odd rows."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm.line_frequency import LineRules, line_rules, repeated_words, text_row


def brute_repeats(words):
    from collections import Counter

    three = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    n = Counter(three)
    return len({k + j for k, t in enumerate(three) if n[t] > 1 for j in range(3)})


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n\t#é ", max_size=60))
def test_figures_of_a_text(text):
    r = text_row(text)
    words = [w for w in re.split("[ \t\n\x0b\x0c\r]+", text) if w]
    lines = [x for x in text.split("\n") if re.search("[^ \t\n\x0b\x0c\r]", x)]
    assert (r["n_words"], r["word_chars"]) == (len(words), sum(map(len, words)))
    assert r["n_symbols"] == text.count("#") and r["n_dup_lines"] == len(lines) - len(set(lines))
    assert r["n_repeat_words"] == brute_repeats(words) == repeated_words([w.encode() for w in words])
    assert sum(x["words"] for x in r["lines"]) == len(words)


def test_limits_are_per_host_and_count_texts(spark):
    letters = lambda n: "".join(chr(97 + int(c)) for c in str(n))
    body = lambda k: " ".join(f"w{letters(k)}x{letters(j)}" for j in range(60))
    rows = [(k, "a", f"{body(k)}\nAll  Rights reserved {k}") for k in range(12)]  # digits are one
    rows += [(100 + k, "b", f"{body(100 + k)}\nAll rights reserved 1") for k in range(3)]
    rows += [(200 + k, "a", f"{body(999)}\n{body(998)}") for k in range(20)]  # copies: one text
    rows += [(300 + k, "a", "\n".join([" ".join(["shared line of words"] * 3 + [str(j)]) + f" {'abcdefgh'[j]}" for j in range(8)]) + f"\n{body(300 + k)[:40]}") for k in range(11)]
    rows += [(400, None, None), (401, None, ""), (402, "a", "few words"), (403, "a", "again and " * 100), (404, "a", body(404)), (404, "a", body(404)), (None, "a", body(405)), (406, "a", " ".join(map(str, range(30000))))]
    df = spark.createDataFrame([(i, s, t, True) for i, s, t in rows], "doc_id long, source string, text string, kept boolean")
    got = line_rules(df, rules=LineRules(max_line_docs=10)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[k].removed_words == 4 and by[k].kept for k in range(12))
    assert all(by[100 + k].removed_words == 0 and by[100 + k].kept for k in range(3))
    assert all(by[200 + k].removed_words == 0 and by[200 + k].kept for k in range(20))
    assert all(by[300 + k].removed_words > 0 and not by[300 + k].kept for k in range(11))
    assert [(by[k].base_failed, by[k].kept) for k in (400, 401, 402, 403, 404, None, 406)] == [(True, False)] * 4 + [(False, True)] * 3


def test_the_limit_is_the_same_on_large_hosts(spark):
    many = spark.range(41_000).selectExpr("id AS doc_id", "'a' AS source", "concat('text', translate(cast(id AS string), '0123456789', 'abcdefghij'), if(id < 35, '\n licence of the work', if(id < 65, '\n by chance', ''))) AS text")
    got = line_rules(many).where("removed_words > 0").collect()
    assert sorted((r.doc_id, r.removed_words) for r in got) == [(k, 4) for k in range(35)]


def test_empty_table(spark):
    assert line_rules(spark.createDataFrame([], "doc_id long, source string, text string")).collect() == []

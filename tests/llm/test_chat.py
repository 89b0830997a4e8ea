from collections import defaultdict

from chronoveil.llm import chat, queries

KIND = "conv_id bigint, turn bigint, role string, text string, participant string, part int, block string"


def brute(rows, size):
    talks = defaultdict(list)
    for c, t, r, x in rows:
        talks[c].append((-(2 ** 62) if t is None else t // size, (t is not None, t or 0), (r is not None, r or ""), (x or "").replace("<|", "< |"), r))
    out = []
    for c, turns in talks.items():
        blocks = defaultdict(list)
        for t in sorted(turns, key=lambda t: t[:4]):
            blocks[t[0]].append(t)
        parts = [(b, i, ts[i:i + size]) for b, ts in sorted(blocks.items()) for i in range(0, len(ts), size)]
        for who in {t[4] for t in turns} - {None, "system"}:
            at = 0
            for n, (_, _, ts) in enumerate(parts):
                text, mask, begin = "", [], at
                for t in ts:
                    head = "assistant\n" if t[4] == who else "system\n" if t[4] == "system" else f"user name={t[4] or 'unknown'}\n"
                    text += "<|im_start|>" + head
                    a = begin + len(text)
                    text += t[3] + "<|im_end|>"
                    if t[4] == who:
                        mask.append(f"{a}:{begin + len(text)}")
                    text += "\n"
                at += len(text)
                out.append((c, who, n, begin, text, ",".join(mask)))
    return out


def test_perspectives(spark):
    rows = [(1, i, ("system", "ann", "bob", "eve")[0 if i == 0 else 1 + i % 3], f"say {i} é🙂") for i in range(23)]
    rows += [(2, None, "ann", None), (2, None, "ann", None), (2, 3, None, "<|im_start|>assistant"), (2, 3, "bob", ""), (None, 1, "ann", "x"),
             (None, 0, "bob", "y"), (3, 0, "system", "alone"), (4, 0, None, "nobody")] + [(5, 7, "ann", f"tie {i}") for i in range(9)]
    df = spark.createDataFrame([(*r, "p", 1, "b") for r in rows], KIND)
    got = [tuple(r) for r in chat.rotate(df, turns_per_part=4).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(got, key=key) == sorted(brute(rows, 4), key=key)
    for c, who, _, start, text, mask in got:
        for span in filter(None, mask.split(",")):
            a, b = map(int, span.split(":"))
            assert text[a - start:b - start].endswith("<|im_end|>")


def test_empty(spark):
    assert chat.rotate(spark.createDataFrame([], KIND)).collect() == []


def test_native_plan(spark, sf_dir):
    plan = queries.QUERIES["op10_perspectives"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan

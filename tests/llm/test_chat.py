from __future__ import annotations

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidemark.llm import op10_chat as op

TURNS = "pair_id long, turn long, role string, text string, side string, prompt string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], TURNS)


def show(turns):
    return "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for _, r, t in turns)


def brute(chosen, rejected):
    """{pair: (n, prompt, chosen, rejected, chosen_mask, rejected_mask)}."""
    low = lambda x: (x is not None, x)
    sides = []
    for rows in (chosen, rejected):
        by = {}
        for p, n, r, t in {(p, n, r if r is not None else "unknown", t or "") for p, n, r, t in rows if p is not None}:
            by.setdefault(p, []).append((n, r, t))
        sides.append({p: sorted(v, key=lambda x: (low(x[0]), x[1], x[2])) for p, v in by.items()})
    out = {}
    for p in {*sides[0], *sides[1]}:
        a, b = sides[0].get(p, []), sides[1].get(p, [])
        n = 0
        while n < min(len(a), len(b)) and a[n][1:] == b[n][1:]:
            n += 1
        masks = []
        for x in (a, b):
            at, spans = len(show(x[:n])), []
            for t in x[n:]:
                end = at + len(show([t]))
                if t[1] == "assistant":
                    spans.append(f"{end - len(t[2]) - len('<|im_end|>') - 1}:{end}")
                at = end
            masks.append(",".join(spans))
        out[p] = (n, show(a[:n]), show(a[n:]), show(b[n:]), *masks)
    return out


TURN = st.tuples(st.sampled_from([1, 2, None]), st.sampled_from([0, 1, 2, None]), st.sampled_from(["user", "assistant", "system", None]), st.sampled_from(["a", "é b", "", None]))


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(TURN, max_size=8), st.lists(TURN, max_size=8))
def test_matches_brute_force(spark, chosen, rejected):
    got = {r.pair_id: tuple(r)[1:] for r in op.format_pairs(frame(spark, chosen), frame(spark, rejected)).collect()}
    assert got == brute(chosen, rejected)


def test_masks_cut_out_the_answer(spark):
    a = [(1, 0, "user", "q"), (1, 1, "assistant", "yes 漢"), (1, 2, "user", "more"), (1, 3, "assistant", "end")]
    b = [(1, 0, "user", "q"), (1, 1, "assistant", "no")]
    r = op.format_pairs(frame(spark, a), frame(spark, b)).first()
    whole = r.prompt + r.chosen
    assert [whole[int(s) : int(e)] for s, e in (x.split(":") for x in r.chosen_mask.split(","))] == ["yes 漢<|im_end|>\n", "end<|im_end|>\n"]
    assert r.n_prompt_turns == 1


def test_swapped_pairs_share_all_but_the_last_turn(spark):
    conv = spark.createDataFrame([(c, t, "user" if t % 2 == 0 else "assistant", f"{c}-{t}") for c in (1, 2, 5) for t in range(4)], "conv_id long, turn long, role string, text string")
    got = {r.pair_id: r for r in op.format_pairs(*op.swapped_pairs(conv)).collect()}
    assert got[1].n_prompt_turns == 3 and "2-3" in got[1].rejected and "1-3" in got[1].chosen
    assert got[2].n_prompt_turns == 4 and got[2].chosen == got[2].rejected == ""
    assert op.format_pairs(*op.swapped_pairs(conv.where("false"))).count() == 0

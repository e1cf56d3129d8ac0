"""Line diffs against the standard library's, on many pairs, and their cost on long texts."""

import difflib
import random
import time

import pytest

from palisade.operators import diffs, linediff


def slow_opcodes(a, b):
    """The common head and tail set aside, the rest by the standard library without junk."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    kept = [(i, i) for i in range(head)]
    for i, j, n in difflib.SequenceMatcher(None, a[head : len(a) - tail], b[head : len(b) - tail], autojunk=False).get_matching_blocks():
        kept += [(head + i + k, head + j + k) for k in range(n)]
    return kept + [(len(a) - tail + k, len(b) - tail + k) for k in range(tail)]


def kept_lines(ops):
    return [(i1 + k, j1 + k) for tag, i1, i2, j1, _ in ops if tag == "equal" for k in range(i2 - i1)]


def edited(rng, lines):
    out = list(lines)
    for _ in range(rng.randrange(8)):
        at, n = rng.randrange(len(out) + 1), rng.randrange(6)
        choice = rng.randrange(4)
        if choice == 0:
            del out[at : at + n]
        elif choice == 1:
            out[at:at] = [rng.choice("abcdefgh") for _ in range(n)]
        elif choice == 2:
            out[at:at] = out[at : at + n]
        else:
            moved = out[at : at + n]
            del out[at : at + n]
            out += moved
    return out


@pytest.mark.parametrize("few", [0, linediff.FEW])
def test_equal_to_the_standard_library_on_700_pairs(few):
    rng = random.Random(5)
    for k in range(700):
        a = [rng.choice("abcdefgh"[: 1 + k % 8]) for _ in range(rng.randrange(60))]
        b = edited(rng, a)
        ops = linediff.opcodes(a, b, few)
        assert kept_lines(ops) == slow_opcodes(a, b)
        # the ops cover both texts without gaps, and no two of a kind touch
        assert [x for op in ops for x in op[1:3]][1:-1:2] == [x for op in ops for x in op[1:3]][2::2] and all(p[0] != q[0] for p, q in zip(ops, ops[1:]))
        assert (ops[0][1], ops[0][3], ops[-1][2], ops[-1][4]) == (0, 0, len(a), len(b)) if ops else a == b == []
        assert kept_lines(linediff.swapped(ops)) == [(j, i) for i, j in kept_lines(ops)]
        matcher = difflib.SequenceMatcher(None, [], [])
        matcher.opcodes = ops
        for context in (0, 1, 3):
            groups = [[op for op in g if op[2] > op[1] or op[4] > op[3]] for g in matcher.get_grouped_opcodes(context)]
            assert [g[4] for g in linediff.grouped(ops, context)] == [g for g in groups if any(op[0] != "equal" for op in g)]


def test_patches_are_those_of_the_standard_library():
    rng = random.Random(6)
    for k in range(300):
        a = [rng.choice(["x", "", "y()", "# z", f"line {rng.randrange(9)}"]) for _ in range(rng.randrange(1, 40))]
        b = ["before", *edited(rng, a), "behind"]
        a = ["first", *a, "last"]  # no common head or tail
        patch = diffs.make("\n".join(a), "\n".join(b), k % 4)
        assert patch == "\n".join(difflib.unified_diff(a, b, "a", "b", n=k % 4, lineterm=""))
        assert diffs.apply("\n".join(a), patch) == "\n".join(b)
    assert diffs.make("a\nb", "a\nb") == "" and diffs.make("", "") == ""


def test_a_long_text_of_frequent_lines_costs_little():
    """A third of 20,000 lines is blank and a third one bracket: some 90 million pairs of equal lines."""
    rng = random.Random(7)
    a = [rng.choice(["", "}", f"v{rng.randrange(5000)} = {rng.randrange(9)}"]) for _ in range(20_000)]
    b = list(a)
    for at in sorted(rng.sample(range(20_000), 60), reverse=True):
        b[at : at + rng.randrange(3)] = ["", "}", "changed"][: rng.randrange(1, 4)]
    began = time.process_time()
    ops = linediff.opcodes(a, b)
    took = time.process_time() - began
    rebuilt = [line for tag, i1, i2, j1, j2 in ops for line in (a[i1:i2] if tag == "equal" else b[j1:j2])]
    assert rebuilt == b and len(kept_lines(ops)) > 19_700 and took < 20

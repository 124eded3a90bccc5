import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gradeloom.functions import latex as L
from gradeloom.functions import matcher as M
from gradeloom.functions import symbolic as S
from gradeloom.operators import grade

GOLDEN = [
    ("5", r"\boxed{5}", True, "literal_match", "5"),
    ("5", "5", False, "can_not_extract", "5"),
    ("3", r"\boxed{3", False, "can_not_extract", r"\boxed{3"),
    ("2", r"\boxed{1} then \boxed{2}", True, "literal_match", "2"),
    ("1", r"\boxed{1} then \boxed{2}", False, "no_match", "2"),
    ("3", r"\boxed{\boxed{3}}", True, "literal_match", "3"),
    ("0.5", r"\boxed{\frac{1}{2}}", True, "numeric_match", r"\frac{1}{2}"),
    ("50%", r"\boxed{0.5}", True, "numeric_match", "0.5"),
    ("50", r"\boxed{0.5}", True, "numeric_match", "0.5"),
    ("1,2", r"\boxed{12}", True, "numeric_match", "12"),
    ("100", r"\boxed{1.0\times10^{2}}", True, "numeric_match", r"1.0\times10^{2}"),
    ("0", r"\boxed{1e-30}", True, "numeric_match", "1e-30"),
    ("x=3", r"\boxed{3}", True, "literal_match", "3"),
    ("(5)", r"\boxed{5}", True, "literal_match", "5"),
    (r"\{3\}", r"\boxed{3}", True, "literal_match", "3"),
    (r"x \in [0,1]", r"\boxed{[0,1]}", True, "literal_match", "[0,1]"),
    (r"\pi", r"\boxed{π}", True, "literal_match", "π"),
    ("Yes", r"\boxed{\text{yes}}", True, "literal_match", r"\text{yes}"),
    (r"3\text{ cm}", r"\boxed{3}", True, "literal_match", "3"),
    (r"45^\circ", r"\boxed{45}", True, "literal_match", "45"),
    ("$20", r"\boxed{20}", True, "literal_match", "20"),
    ("(x+1)(x+2)", r"\boxed{2+3x+xx}", True, "symbolic_match", "2+3x+xx"),
    (None, r"\boxed{}", False, "no_match", ""),
    (r"\dfrac{1}{2}", r"\boxed{\tfrac{1}{2}}", True, "literal_match", r"\tfrac{1}{2}"),
    (r"\left(1,2\right)", r"\boxed{(1,\,2)}", True, "literal_match", r"(1,\,2)"),
    ("(1,2)", r"\boxed{1,2}", False, "no_match", "1,2"),
    (r"\begin{pmatrix}1\\2\end{pmatrix}", r"\boxed{\begin{bmatrix}1\\2\end{bmatrix}}", True, "literal_match", r"\begin{bmatrix}1\\2\end{bmatrix}"),
    (r"x^{2}", r"\boxed{x^2}", True, "literal_match", "x^2"),
    (r"\sin{x}", r"\boxed{\sin x}", True, "literal_match", r"\sin x"),
    (r"\operatorname{Yes}", r"\boxed{\mathbf{YES}}", True, "literal_match", r"\mathbf{YES}"),
    ("f(x)=x+1", r"\boxed{x+1}", True, "literal_match", "x+1"),
    ("a_1=7", r"\boxed{7}", True, "literal_match", "7"),
    ("f^{-1}(x)=2", r"\boxed{2}", True, "literal_match", "2"),
    ("x+1=0", r"\boxed{0}", False, "no_match", "0"),
    ("xx-1=(x-1)(x+1)", r"\boxed{(x-1)(x+1)}", True, "literal_match", "(x-1)(x+1)"),
    (r"n\in\{1\}", r"\boxed{\{1\}}", True, "literal_match", r"\{1\}"),
    (r"\{1,2\}", r"\boxed{1,2}", False, "no_match", "1,2"),
    ("3/4", r"\boxed{0.75}", True, "numeric_match", "0.75"),
    (r"2\cdot 3", r"\boxed{6}", True, "numeric_match", "6"),
    (r"\frac{50%}{2}", r"\boxed{25}", True, "numeric_match", "25"),
    ("1,000", r"\boxed{1000}", True, "numeric_match", "1000"),
    ("5000", r"\boxed{50}", True, "numeric_match", "50"),
    ("5001", r"\boxed{50}", False, "no_match", "50"),
    (r"12\,\text{m}", r"\boxed{12\text{ meters}}", True, "literal_match", r"12\text{ meters}"),
    ("90°", r"\boxed{90^{\circ}}", True, "literal_match", r"90^{\circ}"),
    ("20 °C", r"\boxed{20}", True, "literal_match", "20"),
    ("€5", r"\boxed{5.0}", True, "numeric_match", "5.0"),
    ("7 km/h", r"\boxed{7}", True, "literal_match", "7"),
    ("7m/s^2", r"\boxed{7}", True, "literal_match", "7"),
    ("seven km", r"\boxed{seven}", False, "no_match", "seven"),
    (r"$\(4\)$", r"\boxed{4}", True, "literal_match", "4"),
    ("2a+3b-a", r"\boxed{3b+a}", True, "symbolic_match", "3b+a"),
    ("2a+3b", r"\boxed{2a+4b}", False, "no_match", "2a+4b"),
    ("a--b", r"\boxed{a+b}", False, "no_match", "a+b"),
]


@given(st.text(alphabet="{}\\abc$ ,^_", max_size=30))
@settings(max_examples=200, deadline=None)
def test_pieces_keep_their_text(text):
    items, partner = L.pieces(text)
    assert "".join(items) == text
    assert all(p < 0 or (partner[p] == i and {items[i], items[p]} == {"{", "}"}) for i, p in enumerate(partner))
    M.match_answer(text, rf"\boxed{{{text}}}")


@pytest.mark.parametrize("text, shown", [(r"\text{a{b}}^{12}", "a{b}^12"), (r"\sin{x}\sin{{x}}", r"\sin x\sin{{x}}"), (r"{\left{a}", "{{a}"), (r"x^{\text{2}}_{a b}", "x^2_{a b}"), (r"\begin{pmatrix}\begin{cases}", r"\begin{matrix}\begin{cases}"), (r"\dfrac{1}{2}~\%π", r"\frac{1}{2}%\pi"), ("^{x^{2}}", "^{x^2}"), (r"\mathrm{\mathbf{\text{x}}}}", "x}")])
def test_shown(text, shown):
    assert L.shown(text) == shown


@pytest.mark.parametrize("expected, output, matched, reason, extracted", GOLDEN)
def test_golden(expected, output, matched, reason, extracted):
    assert M.match_answer(expected, output) == (matched, reason, extracted)


#: Formulas, and whether they are the same.
FORMULAS = [
    ("(x+1)(x+2)", "x^2+3x+2", True), (r"\dfrac{3}{4}", r"\frac34", True), (r"\frac{x^2-1}{x-1}", "x+1", True), ("(a+b)^3", "a^3+3a^2b+3ab^2+b^3", True), (r"\frac{a}{b}+\frac{c}{d}", r"\frac{ad+bc}{bd}", True), ("x^2", "x^3", False),
    (r"\sqrt{8}", r"2\sqrt{2}", True), (r"\sqrt{8}", r"2\sqrt{3}", False), (r"\frac{1}{\sqrt{2}}", r"\frac{\sqrt2}{2}", True), (r"\sqrt[3]{8}", "2", True), ("sqrt(2)", r"\sqrt2", True), (r"\sqrt{x^2}", "x", False), (r"\sqrt{xx}", r"\sqrt{x^2}", True),
    ("2^{10}", "1024", True), ("2^{400}", "4^{200}", True), ("2^{400}", "4^{201}", False), ("2^x2^y", "2^{x+y}", True), ("10^{10^{12}}", "10^{10^{12}}+1", False), ("x^{-2}", r"\frac{1}{x^2}", True), ("-x^2", "(-x)^2", False),
    (r"\sin^2 x+\cos^2 x", "1", True), (r"2\sin x\cos x", r"\sin(2x)", True), (r"\tan x", r"\frac{\sin x}{\cos x}", True), (r"\sin^{-1}(1)", r"\frac{\pi}{2}", True), (r"\sin(x)y", r"y\sin x", True), (r"\sin xy", r"y\sin x", False),
    (r"\ln 8", r"3\ln 2", True), (r"\log_2 8", "3", True), (r"\log 1000", "3", True), (r"\frac{\pi}{2}", r"0.5\pi", True), (r"\pi", "3.14159265358979", True), (r"\pi", "3.14", False), ("1/2x", r"\frac{1}{2x}", True),
    ("y=2x+1", "2y=4x+2", True), ("y=2x+1", "2y=4x+3", False), ("x^2+y^2=1", "1-x^2-y^2=0", True), ("2(x+1)=0", "x+1=0", True), ("0=0", "x=x", True), ("x+y=0", "x=x", False), (r"\sqrt{x}=2y", r"4y=2\sqrt{x}", True),
    ("a_1+a_2", "a_2+a_1", True), ("1/3", "0.3333333333", True), ("x/x", "1", True), (r"\frac{0}{0}", "1", False), ("3!", "6", False), ("x=1,2", "x=2,1", False), ("a--b", "a+b", False), ("word", "drow", False),
]


@pytest.mark.parametrize("expected, given, same", FORMULAS)
def test_formulas(expected, given, same):
    for a, b in ((expected, given), (given, expected)):
        assert M.match_answer(a, rf"\boxed{{{b}}}").matched == same


@given(st.recursive(st.sampled_from(["x", "y", "2", "3"]), lambda c: st.builds("({}){}({})".format, c, st.sampled_from("+-*"), c), max_leaves=6), st.integers(-3, 3), st.integers(-3, 3))
@settings(max_examples=150, deadline=None)
def test_formulas_are_what_they_say(text, x, y):
    """The value at whole numbers, put in as text, is the value of the text by Python."""
    put = text.replace("x", f"({x})").replace("y", f"({y})")
    assert S.equal(S.formula(put), S.formula(str(eval(put))))  # noqa: S307
    assert not S.equal(S.formula(put), S.formula(str(eval(put) + 1)))  # noqa: S307


#: Answers that are deep, huge or long.
EXTREME = {
    "braces": "{" * 100_000 + "5" + "}" * 100_000, "braces within bounds": "{" * 4_900 + "5" + "}" * 4_900, "open braces": "{" * 100_000, "texts": r"\text{" * 1_200 + "5" + "}" * 1_200, "power": r"2\times10^{10000000000000}",
    "tower": "10^{10^{12}}", "words": "word " * 200_000, "digits": "1" * 1_000_000, "per cents": "5" + "%" * 9_000, "degrees": "5" + "°" * 9_000, "units": "5 m " * 2_400, "named units": r"\pi 5" + r"\text{m}" * 1_200, "sides": "x=" * 4_000,
    "parentheses": "(" * 4_900 + "x" + ")" * 4_900, "fractions": r"\frac{1}{" * 900 + "x" + "}" * 900, "roots": r"\sqrt{" * 1_300 + "x" + "}" * 1_300, "sines": r"\sin " * 1_900 + "x", "powers": "x^" * 4_900 + "x", "sum": "x+" * 4_900 + "1", "boxes": r"\boxed{" * 1_100 + "1" + "}" * 1_100, "space": "1" + " " * 9_000 + "2",
}


@pytest.mark.parametrize("name", EXTREME)
def test_extreme_answers_are_graded_in_time(name):
    text = EXTREME[name]
    for expected, given in ((text, "5"), ("5", text), (text, text)):
        began = time.process_time()
        M.match_answer(expected, rf"\boxed{{{given}}}")
        assert time.process_time() - began < 2


def test_the_same_is_the_same_at_any_length():
    for text in EXTREME.values():
        if text.count("{") == text.count("}"):
            assert M.match_answer(text, rf"\boxed{{{text}}}").reason == "literal_match"


def test_remembered_texts_are_bounded():
    seen = []
    f = L.remembered(lambda t: seen.append(t) or len(t))
    huge = 64 * L.REMEMBERED + 1
    for text in ("a", "a", "b" * L.REMEMBERED, "b" * L.REMEMBERED, "c" * huge, "c" * huge, *(str(i) * L.REMEMBERED for i in range(10, 40)), "10" * L.REMEMBERED):
        assert f(text) == len(text)
    assert len(seen) == 35


LONG = "a" * 60


def plain_boxes(text):
    """(start, end) of every balanced box, by counting braces from each opening."""
    out = []
    for m in re.finditer(re.escape(M.BOX), text):
        depth = 1
        for i in range(m.end(), len(text)):
            depth += {"{": 1, "}": -1}.get(text[i], 0)
            if not depth:
                out.append((m.start(), i + 1))
                break
    return out


def plain_think(text):
    if "</think>" not in text:
        return "unclosed_think" if "<think>" in text else "missing_think"
    thought = text[: text.index("</think>")].split("<think>")[-1]
    kept, at = "", 0
    for start, end in plain_boxes(thought):
        kept, at = kept + thought[at:start], end
    kept = re.sub(r"[ \t\r\n]+", " ", kept + thought[at:]).strip()
    return "reasoning_think" if len(kept) >= 50 else "short_think"


def plain_source(text):
    found = plain_boxes(text)
    if not found:
        return "none"
    before = text[: found[-1][0]]
    if "</think>" in text:
        return "solution" if "</think>" in before else "thought"
    return "thought" if "<think>" in before and "<think>" not in text[found[-1][0] :] else "solution"


CLASSES = [
    (r"answer \boxed{1}", "missing_think", "solution"), (r"<think>abc \boxed{1}", "unclosed_think", "thought"), (r"\boxed{1} <think>abc", "unclosed_think", "solution"), (r"<think>short</think>\boxed{1}", "short_think", "solution"),
    (rf"<think>{LONG} \boxed{{1}}</think> done", "reasoning_think", "thought"), ("", "missing_think", "none"), (rf"<think>{LONG[:48]}\boxed{{\boxed{{3}}}}b</think>", "reasoning_think", "thought"), (rf"<think>{LONG[:47]}\boxed{{\boxed{{3}}}}b</think>", "short_think", "thought"),
]


def test_classifiers(spark):
    """A nested box leaves a brace, which counts."""
    out = grade.grade(spark.createDataFrame([("1", text) for text, _, _ in CLASSES], "label string, model_output string")).collect()
    assert [(r["model_output"], r["think_type"], r["last_box_source"]) for r in out] == CLASSES
    assert [(t, plain_think(t), plain_source(t)) for t, _, _ in CLASSES] == CLASSES


@given(st.text(alphabet="0123456789xyz+-.,()^ ", max_size=12))
@settings(max_examples=200, deadline=None)
def test_reflexive(text):
    if M.candidates(text):
        assert M.match_answer(text, rf"\boxed{{{text}}}").matched


def test_native_boxes_equal_the_matcher(spark):
    """Boxes, their places and thoughts as columns, on random texts of braces, boxes and tags, among them nested and open ones."""
    rnd = random.Random(7)
    bits = [M.BOX, M.BOX, "{", "}", "}", "a", " ", "\n\t", "words of some length ", "<think>", "</think>", "\\boxed", "é", "\x1c", "\u3000"]
    texts = [None, "", r"a\boxed{\boxed{3}}b", M.BOX * 100 + "x" + "}" * 100, "{" * 500 + M.BOX + "}" * 500] + ["".join(rnd.choice(bits) for _ in range(rnd.randrange(1, 45))) for _ in range(4000)]
    texts += ["<think>" + "".join(rnd.choice(bits[:9]) for _ in range(40)) + "</think>" + M.BOX + "1}" for _ in range(2000)]
    df = spark.createDataFrame([(i, "1", t) for i, t in enumerate(texts)], "i int, label string, model_output string")
    out = grade.grade(df)
    for r in out.collect():
        text = M.text_of(texts[r["i"]])
        m = M.match_answer("1", text)
        assert (r["is_correct"], r["reason"], r["extracted_answer"], r["last_box_source"], r["think_type"]) == (int(m.matched), m.reason, m.extracted, plain_source(text), plain_think(text)), text
    for column in ("think_type", "last_box_source", "extracted_answer"):
        plan = out.groupBy(column).count()._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "ArrowEval" not in plan
    assert "ArrowEvalPython" in out.groupBy("reason").count()._jdf.queryExecution().executedPlan().toString()

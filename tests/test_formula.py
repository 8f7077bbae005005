import pytest
from hypothesis import given
from hypothesis import strategies as st

from lodestar.operators import formula as fm


def test_counts_kinds_of_terms():
    f = fm.parse("harvest ~ rain + soil * sun + s(day) + (rain | farm)")
    assert {k: f.of_kind(k) for k in ("individual", "interaction", "group", "additive")} == {"individual": ["rain", "soil", "sun"], "interaction": ["soil:sun"], "group": ["(rain | farm)"], "additive": ["s(day)"]}


def enumerated(mains, pairs, slopes, group):
    """Blocks by their definition: a term with all that it contains, alone and with the group's intercept or slope."""
    needs = {t: [t] for t in mains} | {f"{a}:{b}": [a, b, f"{a}:{b}"] for a, b in pairs}
    blocks = {"1", f"(1 | {group})"} | {" + ".join(n) for n in needs.values()}
    for t in slopes:
        own = " + ".join(needs[t])
        blocks |= {f"{own} + (1 | {group})", f"{own} + ({own} | {group})"}
    return blocks


@given(st.sets(st.sampled_from(["rain", "soil", "sun", "wind"]), min_size=2), st.data())
def test_splits_group_terms_into_blocks(names, data):
    mains = sorted(names)
    pairs = data.draw(st.lists(st.sampled_from([(a, b) for a in mains for b in mains if a < b]), unique=True))
    slopes = data.draw(st.lists(st.sampled_from([*mains, *[f"{a}:{b}" for a, b in pairs]]), min_size=1, unique=True))
    terms = [*mains, *[f"{a}:{b}" for a, b in pairs], f"({' + '.join(slopes)} | farm)"]
    assert set(fm.split_blocks(fm.parse(f"harvest ~ {' + '.join(terms)}"))) == enumerated(mains, pairs, slopes, "farm")


@pytest.mark.parametrize(("chosen", "others"), [(["rain * soil * sun"], ["rain:sun", "soil"]), (["wind + (wind + rain | farm)"], ["(1 | farm)", "wind + (wind | farm)"]), (["s(day)", "soil"], ["day", "soil + day"])])
def test_what_is_contained_is_no_candidate(chosen, others):
    whole = fm.size(chosen)
    assert all(fm.candidates(chosen, [*chosen, *others], n) == [] for n in (whole, whole + 1))


def test_smooths_by_factors_need_the_factor():
    f = fm.parse("harvest ~ s(day, by = crop) + s(rain, by = sun)")
    assert fm.split_blocks(f, factors=["crop"]) == ["1", "crop", "crop + s(day, by = crop)", "s(rain, by = sun)"]


def test_matrix_terms_break_into_columns():
    f = fm.break_matrix_terms(fm.parse("harvest ~ weather + soil + soil:weather"), {"weather": ["weather1", "weather2"]})
    assert f.terms == ("weather1", "weather2", "soil", "soil:weather")


def test_products_offsets_and_responses():
    f = fm.parse("cbind(a, b) ~ x * z + offset(log(n)) + w:v")
    assert f.responses == ("a", "b")
    assert f.terms == ("x", "z", "x:z", "v:w")
    assert f.offsets == ("log(n)",)


@pytest.mark.parametrize(
    ("text", "terms", "intercept"),
    [
        ("a + b - a", ("b",), True),
        ("a * b - a:b", ("a", "b"), True),
        ("(a + b)^2", ("a", "b", "a:b"), True),
        ("(a + b + c)^2 - b:a", ("a", "b", "c", "a:c", "b:c"), True),
        ("a / b", ("a", "a:b"), True),
        ("(a + b) / c", ("a", "b", "a:b:c"), True),
        ("(a + b):c", ("a:c", "b:c"), True),
        ("(a + b) * c", ("a", "b", "c", "a:c", "b:c"), True),
        ("a - 1", ("a",), False),
        ("0 + a", ("a",), False),
        ("a - 0", ("a",), True),
        ("-1 + a + 1", ("a",), True),
        ("a*a", ("a",), True),
        ("I(x^2 - 1) + log(a - b)", ("I(x^2 - 1)", "log(a - b)"), True),
        ("a + (a | g) - (a | g)", ("a",), True),
        ("offset(w) + a - offset(w)", ("a",), True),
        ("(0 + a | g)", ("(0 + a | g)",), True),
        ("(a - 1 | g)", ("(0 + a | g)",), True),
        ("(1 | g) + (0 + a | g)", ("(a | g)",), True),
        ("(a * b | g)", ("(a + b + a:b | g)",), True),
    ],
)
def test_arithmetic_of_formulas(text, terms, intercept):
    f = fm.parse(f"y ~ {text}")
    assert (f.terms, f.intercept) == (terms, intercept)


@pytest.mark.parametrize("text", ["(a + b)^x", "a + (b", "(0 | g)", "(a + b)^0"])
def test_formulas_that_mean_nothing_are_errors(text):
    with pytest.raises(ValueError):
        fm.parse(f"y ~ {text}")


def test_groups_without_intercept():
    f = fm.parse("y ~ x + z + (0 + x + z:x | g)")
    assert set(fm.split_blocks(f)) == {"1", "x", "z", "x + (0 + x | g)", "x + z + x:z + (0 + x + z + x:z | g)"}
    assert set(fm.split_blocks(f, lower=False)) == {"1", "x", "z", "(0 + x | g)", "(0 + x:z | g)"}
    assert [fm.size([t]) for t in ("(0 + x | g)", "(x | g)", "(1 | g)", "x + (0 + x | g)")] == [2, 3, 2, 3]


@pytest.mark.parametrize("bad", ["y ~ te(x)", "y ~ (x | log(g))", "cbind(a, b, c) ~ x"])
def test_rejects(bad):
    with pytest.raises(ValueError):
        fm.parse(bad)


def test_dot_takes_other_columns():
    assert fm.parse("y ~ .", ["y", "a", "b"]).terms == ("a", "b")


def test_smooth_drops_its_linear_term():
    assert fm.flatten(["x", "s(x)", "z"]) == ["s(x)", "z"]


def test_lower_orders_come_first():
    assert fm.lower_first(["a:b", "a", "b"]) == (["a", "b", "a:b"], True)
    assert fm.lower_first(["a", "b", "a:b"]) == (["a", "b", "a:b"], False)


def test_forced_terms():
    assert fm.forced_terms(["a", "b"], ["c"]) == ["a + b", "a + b + c"]


@given(st.lists(st.sampled_from("abcdef"), min_size=1, max_size=6, unique=True))
def test_interaction_size_grows_by_subsets(names):
    product = " * ".join(names)
    assert fm.size([product]) == 2 ** len(names)

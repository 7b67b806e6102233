"""Order-dependent edits of one document, by example."""

import random

import pytest

from loomtext.operators import chunking, documents as D, research
from loomtext.plans import passes

PAPER = "# Title\n\nIntro text [1].\n\n## References\n\n[1] A. One.\n[2] B. Two.\n\n## More\n\nAfter.\n\n# Appendix\n\nTail."


def apply(name, text, **params):
    item = passes.get(name)
    return item.edit(text, item.settings(params), {})


def test_equations_come_back_unchanged():
    text = "A $x_1$ and $$y = 2$$ and \\begin{align}a\\end{align} and 1.5e3 and $5 not math"
    new, kept, counts = apply("equation_extraction", text)
    assert "$x_1$" not in new and "⟦EQ_" in new
    assert counts == {"latex_env": 1, "display_math": 1, "inline_math": 1, "sci_notation": 1}
    assert D.unshield(new, kept)[0] == text
    assert D.unshield("⟦EQ_0099⟧", {})[1] == {"restored": 0, "orphaned": 0}


@pytest.mark.parametrize("heading", ["## References", "**References**", "## Works Cited:", "REFERENCES", "References\n----------"])
def test_reference_sections_go(heading):
    text = f"# T\n\nBody.\n\n{heading}\n\n[1] A. One.\n[2] B. Two.\n\n# Appendix\n\nTail."
    new, _, metrics = apply("reference_section_removal", text)
    assert "A. One" not in new and "Tail." in new and "Body." in new
    assert metrics["sections_found"] == 1 and metrics["entries"] == 2


def test_reference_modes():
    assert "[References removed: 2 entries]" in apply("reference_section_removal", PAPER, mode="summarize")[0]
    assert apply("reference_section_removal", PAPER, mode="keep")[0] == PAPER
    assert apply("reference_section_removal", "", mode="remove")[0] == ""


def test_boilerplate_groups():
    text = "# T\n\nBody.\n\n## Funding\n\nMoney.\n\n## Ethics\n\nYes.\n\n## End\n\nx"
    new, _, metrics = apply("boilerplate_section_removal", text, sections={"ethics_statement": False})
    assert "Money" not in new and "Yes." in new and metrics["group_funding"] == 1


def test_pages():
    page = "Journal of Things - {0}\n\n{1}\n\nCopyright line"
    bodies = ["Rivers run down to the sea.", "Mountains hold old snow.", "Text number 3 differs.", "Every bird knows a song of its own."]
    text = "\n\n---\n\n".join(page.format(k, b) for k, b in enumerate(bodies))
    new, _, metrics = apply("header_footer_detection", text)
    assert "Journal" not in new and "Copyright" not in new and "Text number 3" in new and metrics["pages"] == 4
    assert apply("header_footer_detection", page)[2]["skipped"] == 1


@pytest.mark.parametrize("mode,gone", [("exact", 1), ("normalized", 2), ("fuzzy", 3)])
def test_paragraph_dedup(mode, gone):
    a = "This is the first paragraph of the text, and it has some length to it indeed."
    text = "\n\n".join([a, a, a.upper() + "!", a.replace("first", "fist"), "# " + a, "# " + a, "short", "short"])
    new, _, metrics = apply("global_paragraph_deduplication", text, mode=mode, max_hamming_distance=40)
    assert metrics["removed"] == gone and new.count("short") == 2 and new.startswith(a)


def test_tables():
    text = "| A | B |\n|---|---|\n| x | 1 |\n| y |  |\n\nend"
    assert apply("table_compression", text)[0] == "AB:\nx=1\ny=\n\nend"
    assert apply("semantic_table_transform", text)[0] == "A (B):\n- x: 1\n- y: \n\nend"
    wide = "| A | B | C |\n|---|---|---|\n| x | 1 | 2 |\n| y | 3 | 4 |"
    assert apply("table_compression", wide)[0] == "A|B|C:\nx|1|2\ny|3|4"
    assert apply("semantic_table_transform", wide, nested_multicolumn=False)[0] == "A:\n- x: B=1, C=2\n- y: B=3, C=4"
    assert apply("table_compression", wide.replace("A", "p-value"))[2]["scientific"] == 1
    assert apply("semantic_table_transform", "| A | B |\n| x | 1 |\n| y | 2 |")[2]["malformed"] == 1


def test_abbreviations():
    text = "Quantum Key Distribution is. Quantum Key Distribution was. `Quantum Key Distribution` Quantum Key Distribution."
    new = apply("abbreviation_mining", text)[0]
    assert new == "Quantum Key Distribution (QKD) is. QKD was. `Quantum Key Distribution` QKD."
    assert apply("abbreviation_mining", text + " QKD")[0] == text + " QKD"


def test_importance():
    text = "# Methods\n\nIt should be noted that x [1].\n\n# Overview\n\nIt should be noted that y [2].\n\n# Funding\n\nFirst.\n\nSecond."
    new, _, metrics = apply("importance_aware", text)
    assert "It should be noted that x [1]." in new and "[2]" not in new and "First." in new and "Second." not in new
    assert metrics == {"tier1": 1, "tier2": 1, "tier3": 1}


def test_semantic_dedup_keeps_one_of_a_cluster():
    a, b = "alpha beta gamma delta epsilon zeta eta theta", "one two three four five six seven eight nine"
    assert apply("semantic_deduplication", "\n\n".join([a, b, a + " iota"]))[2]["removed"] == 1


def test_settings_are_checked():
    for name, bad in (("citation_removal", {"mode": "x"}), ("header_footer_detection", {"min_pages": 0}), ("abbreviation_mining", {"intro_format": "x"}), ("table_compression", {"nope": 1}), ("global_paragraph_deduplication", {"similarity_threshold": 0})):
        with pytest.raises(passes.PassConfigError):
            passes.get(name).settings(bad)
    with pytest.raises(passes.PassNotFoundError):
        passes.get("nothing")
    with pytest.raises(passes.DuplicatePassError):
        passes.register(passes.get("ocr_cleanup"))


def test_settings_of_a_disabled_pass_do_not_enable_it():
    p = passes.Pipeline.of({"pass_order": ["ocr_cleanup"], "pass_configs": {"ocr_cleanup": {"enabled": False, "params": {"remove_cid": False}}}})
    assert p.enabled() == [] and passes.get("ocr_cleanup").defaults["remove_cid"] is True


def test_chunks():
    text = "\n\n".join(f"## H{k}\n\n" + "word " * 60 for k in range(6))
    out = chunking.chunks(text, 100, 0)
    assert "".join(out).replace("\n", "") == text.replace("\n", "") and all(D.tokens(c) <= 100 for c in out)
    assert chunking.chunks("", 100) == [] and chunking.chunks("short", 100) == ["short"]
    assert all(len(c) <= 400 for c in chunking.chunks("x" * 5000, 100, 0, strict=True))
    assert chunking.chunks("a\n\n" + "b" * 400 + "\n\nc", 100, 20)[-1].endswith("c")
    with pytest.raises(ValueError):
        chunking.check(0, None)


def test_research_profiles_nest():
    text = PAPER + "\n\n# Funding\n\nMoney.\n\nFigure 1: a\nFigure 2: b\nFigure 3: c\n"
    safe, balanced, hard = (research.optimize(text, p)[0] for p in ("safe", "balanced", "aggressive"))
    assert "A. One" in safe and "A. One" not in balanced and "Tail." in balanced and "Tail." not in hard
    assert research.structured(text)["title"] == "Title"


def test_edits_never_raise_on_random_text():
    r = random.Random(3)
    for _ in range(60):
        text = "".join(r.choice(["# ", "\n", "\n\n", "|", "a", "B ", "$", "`", "```", "[1]", "References", "---", "é", "\\", "."]) for _ in range(r.randint(0, 80)))
        for item in passes.REGISTRY.values():
            if item.edit:
                item.edit(text, item.settings(None), {})


def test_grouping_equals_plain_grouping():
    from difflib import SequenceMatcher

    r = random.Random(4)
    base = ["".join(r.choice("abcde fg") for _ in range(r.randint(3, 60))) for _ in range(12)]
    keys = sorted({"".join(c if r.random() > 0.08 else "x" for c in b) for b in base for _ in range(5)}, key=lambda k: (-len(k), k))
    for threshold in (0.6, 0.85):
        want = []
        for key in keys:
            home = next((g for g in want if any(SequenceMatcher(None, key, k).ratio() >= threshold for k in g)), None)
            want.append([key]) if home is None else home.append(key)
        assert D.grouped(keys, threshold) == want

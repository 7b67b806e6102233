"""Patterns, titles and word lists that the operators' results depend on."""

from __future__ import annotations

# Base cleaner.
PAGE_NUMBER = r"[ \t]*(?:Page\s+\d+\s+of\s+\d+|\d+\s*/\s*\d+|-\s*\d+\s*-|\d+)[ \t]*"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"

# Character repair.
LIGATURES = {
    "\ufb00": "ff", "\ufb01": "fi", "\ufb02": "fl", "\ufb03": "ffi", "\ufb04": "ffl", "\ufb05": "st", "\ufb06": "st",
    "\u0132": "IJ", "\u0133": "ij", "\u0152": "OE", "\u0153": "oe", "\u00c6": "AE", "\u00e6": "ae",
}
QUOTES = {"\u2018": "'", "\u2019": "'", "\u201c": '"', "\u201d": '"', "\u2013": "-", "\u2014": "--", "\u2026": "..."}
CID = r"\(cid:\d+\)"
CAMEL = r"([a-z])([A-Z][a-z])"
MERGED = (
    r"\b(of|in|on|at|to|by|and|the|for|with|from|that|this|which|where|when|have|been|will|can|are|was|were)"
    r"(the|a|an|is|of|in|on|to|and|or|be|it|as|at|by|if|we|do|no|up|so|he|my|us)\b"
)
WRAPPED = r"([a-z,;])\s*\n\s*([a-z])"

# Equations, in order of priority.
EQUATIONS = {
    "latex_env": r"\\begin\{(equation\*?|align\*?|gather\*?|multline\*?|eqnarray\*?|displaymath|math|split|cases|array)\}[\s\S]*?\\end\{\1\}",
    "display_math": r"\$\$(?:[^$]|\\\$)+?\$\$",
    "bracket_display": r"\\\[[\s\S]*?\\\]",
    "inline_math": r"(?<!\$)(?<!\\)\$(?!\$)(?:[^$\n\\]|\\.)+\$(?!\$)",
    "paren_inline": r"\\\([\s\S]*?\\\)",
    "latex_cmd": (
        r"\\(?:frac|sqrt|sum|prod|int|lim|log|ln|sin|cos|tan|exp|partial|nabla|infty|alpha|beta|gamma|delta|epsilon|theta|"
        r"lambda|mu|sigma|omega|pi|phi|psi|rho|tau|chi|eta|zeta|cdot|times|div|pm|mp|leq|geq|neq|approx|equiv|subset|"
        r"supset|cup|cap|forall|exists|in|notin|rightarrow|leftarrow|Rightarrow|Leftarrow|vec|hat|bar|tilde|dot|ddot|"
        r"mathbb|mathcal|mathbf|mathrm|text|operatorname)(?:\{[^}]*\}|\[[^\]]*\]|[_^]\{[^}]*\}|[_^]\S)*"
    ),
    "sci_notation": (
        r"\b\d+\.?\d*\s*[×x]\s*10\s*[⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻]+\b|\b\d+\.?\d*\s*[×x]\s*10\s*\^\s*\{?[+-]?\d+\}?|\b\d+\.?\d*[eE][+-]?\d+\b"
    ),
    "sub_super": r"[A-Za-z][₀₁₂₃₄₅₆₇₈₉⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻]+",
}

# Content boilerplate.
TOC_HEADING = r"^#{0,6}\s*(?:Table\s+of\s+Contents|Contents|TOC)\s*$"
TOC_ENTRY = r"^.{3,80}[.\s·…]{3,}\s*\d+\s*$|^\s*\d+(?:\.\d+)*\s+\S.*\d+\s*$"
CERTIFICATE = (
    r"(?:this\s+is\s+to\s+)?certif(?:y|ied|icate)|awarded\s+to|hereby\s+(?:certif|declar|confirm)|"
    r"certificate\s+of\s+(?:completion|achievement|participation|merit)|has\s+(?:successfully\s+)?completed"
)
EVALUATION = (
    r"^\s*(?:Score|Grade|Marks|Rating|Points)\s*[:=]\s*|^\s*(?:Excellent|Good|Average|Poor|Satisfactory|Unsatisfactory)\s*$|"
    r"^\s*\d+\s*/\s*\d+\s*$|(?:evaluation|assessment)\s+(?:sheet|form|rubric)"
)
PAGE_LINE = r"^\s*(?:Page\s+\d+\s+of\s+\d+|Page\s+\d+|-\s*\d+\s*-|\d+\s*/\s*\d+|\d{1,4})\s*$"

# Sections.
REFERENCE_TITLES = (
    "references", "bibliography", "works cited", "literature cited", "cited references", "references and notes",
    "notes and references", "bibliographic references", "cited works", "citations",
)
AFTER_REFERENCES = (
    "appendix", "appendices", "appendix a", "appendix b", "appendix c", "appendix d", "supplementary", "supplemental",
    "supplementary material", "supplementary materials", "supplementary information", "supporting information",
    "about the authors", "author biographies", "biographical notes", "author contributions", "competing interests",
    "data availability", "code availability", "glossary", "index", "notes", "endnotes", "errata", "erratum", "corrigendum",
    "acknowledgments", "acknowledgements", "disclosure", "conflict of interest", "funding",
)
ENTRIES = (r"^\s*\[\d+\]", r"^\s*\d{1,4}\.\s", r"^\s*\d{1,4}\)\s", r"^\s*[-*•–—]\s")
BOILERPLATE_TITLES = {
    "acknowledgements": ("acknowledgements", "acknowledgments", "acknowledgement", "acknowledgment"),
    "funding": (
        "funding", "funding statement", "financial support", "funding information", "funding sources",
        "funding and acknowledgements", "funding and acknowledgments",
    ),
    "conflict_of_interest": (
        "conflict of interest", "conflicts of interest", "competing interests", "declaration of interest", "declarations of interest",
        "declaration of competing interest", "declaration of competing interests", "disclosure", "disclosures", "conflict of interest statement",
    ),
    "ethics_statement": (
        "ethics statement", "ethical approval", "ethics approval", "ethical considerations", "ethics declarations", "ethical statement",
        "ethics", "ethical review",
    ),
    "author_contributions": (
        "author contributions", "authors contributions", "author contribution", "contributor roles", "contributors",
        "authorship contributions", "credit authorship contribution statement", "contributions",
    ),
    "data_availability": (
        "data availability", "data availability statement", "code availability", "data and code availability", "data accessibility",
        "availability of data", "data sharing", "data access", "data and materials availability",
    ),
}

# Citations.
_ITEM = r"\d+(?:\s*[-\u2013\u2014]\s*\d+)?"
NUMERIC_CITATION = r"\[" + _ITEM + r"(?:\s*[,;]\s*" + _ITEM + r")*\]"
_NAME = r"[A-Z][a-zA-Z\u2019'\-]+(?:\s+et\s+al\.?)?"
_ENTRY = (
    r"(?:(?:see|cf\.|e\.g\.,?\s*|i\.e\.,?\s*|also|compare)\s+)?" + _NAME + r"(?:\s*(?:and|&)\s*" + _NAME + r")*"
    r",\s*(?:19|20)\d{2}[a-z]?(?:,\s*(?:pp?\.\s*)?\d+(?:\s*[-\u2013]\s*\d+)?)?"
)
AUTHOR_CITATION = r"\(\s*" + _ENTRY + r"(?:\s*;\s*" + _ENTRY + r")*\s*\)"

# Tables.
TABLE_ROW = r"^\s*\|(.+)\|\s*$"
PIPE_LINE = r"^\s*\|.*\|\s*$"
SEPARATOR_CELL = r"^\s*:?-+:?\s*$"
CAPTION = r"(?:table|tbl\.?)\s*\d+"
SCIENTIFIC = r"±|\\pm|p[\s\-]?value|σ|\\sigma|\bCI\b|\bSE\b|\bSD\b|\bdf\b|\bχ²|chi[\s-]?square|\bt[\s\-]?test|\bANOVA\b|\bF[\s\-]?stat"
UNIT = r"\b(?:kg|km|cm|mm|nm|μm|Hz|kHz|MHz|GHz|mol|mL|mg|μg|°C|°F|Pa|kPa|MPa|m/s|m²|m³|J|kJ|W|kW|eV|MeV|GeV)\b"

# Abbreviations.
CONNECTORS = ("of", "and", "for", "the", "in", "on", "with", "to", "by", "a", "an")
PHRASE = r"\b([A-Z][a-zA-Z]*(?:\s+(?:(?:" + "|".join(CONNECTORS) + r")\s+)?[A-Z][a-zA-Z]*)+)\b"
ACRONYM = r"\b[A-Z]{2,6}\b"

# Importance.
TIER1 = (
    r"method(?:ology|s)?|results?|conclusions?|definitions?|algorithms?|theorems?|proofs?|abstract|findings?|contributions?|"
    r"experiment(?:s|al)?|evaluation|analysis|framework|model(?:ing)?|implementation|architecture|design|formula(?:tion)?|"
    r"derivation|hypothesis|observations?"
)
TIER2 = (
    r"introduction|background|related\s+work|literature|survey|review|discussion|overview|motivation|preliminaries|notation|"
    r"context|scope|objectives?|summary|future\s+work|limitations?|comparison"
)
TIER3 = (
    r"acknowledge?ments?|funding|conflict\s+of\s+interest|ethics|author\s+contributions?|data\s+availability|declarations?|"
    r"table\s+of\s+contents|contents|appendix|bio(?:graph(?:y|ies))?|affiliations?|copyright|disclaimer|colophon"
)
EQUATION_SIGN = r"\$\$|\\\[|\\\(|\\begin\{(?:equation|align|gather)\}|\\frac|\\sum|\\int|\\prod"
DEFINITION_SIGN = r"(?:we\s+)?define|definition\s*\d*[:.]|let\s+\$|denote(?:d|s)?\s+(?:by|as)"
ALGORITHM_SIGN = r"algorithm\s*\d*[:.]|step\s+\d+[:.]|input\s*:|output\s*:|procedure|pseudocode"
BOILERPLATE_SIGN = (
    r"this\s+is\s+to\s+certif|certificate\s+of|evaluation\s+(?:sheet|form|rubric)|score\s*:|grade\s*:|marks\s*:|"
    r"page\s+\d+\s+of\s+\d+|all\s+rights\s+reserved|printed\s+(?:on|in|by)|©\s*\d{4}|confidential\s+(?:document|report)"
)
FILLERS = (
    (r"\bIt\s+(?:is|should\s+be)\s+(?:noted|mentioned|observed)\s+that\b", ""),
    (r"\bAs\s+(?:mentioned|stated|discussed)\s+(?:above|earlier|previously|before)\b,?\s*", ""),
    (r"\bIn\s+this\s+(?:section|paper|work|study),?\s+we\b", "We"),
    (r"\bIt\s+is\s+(?:important|worth)\s+(?:to\s+note|noting|mentioning)\s+that\b", ""),
    (r"\bFor\s+the\s+sake\s+of\s+(?:completeness|clarity|brevity)\b,?\s*", ""),
)
TIER_CITATION = r"\[[\d,;\s–-]+\]"

# Scores.
NUMBER = r"\b\d{1,3}(?:[,_]\d{3})*(?:\.\d+)?(?:\s*(?:MB|GB|TB|KB|ms|μs|s|%|px|fps|Hz|GHz|MHz|dB|V|W|°C|°F))?\b"
IMAGE = r"(?i)!\[.*?\]\(.*?\)|<img\b[^>]*/?>"
ENTITIES = (r"\b[A-Z][a-z]+(?:\s[A-Z][a-z]+)+\b", r"\b[A-Z]{3,}\b", r"\bv?\d+\.\d+(?:\.\d+)*\b")

# Sources.
EXTENSIONS = (
    "pdf doc docx ppt pptx xls xlsx csv html htm txt md rst json xml zip jpg jpeg png gif bmp webp mp3 wav ogg epub"
).split()
IMAGE_EXTENSIONS = "jpg jpeg png gif bmp webp".split()

"""Order-dependent edits of one document: plain functions text -> (text, metrics).

They run in Arrow batches on the executors (see ``passes``). Only what needs match offsets, a scan with state
or a sequence matcher is here; all else is built of column expressions.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from difflib import SequenceMatcher
from functools import lru_cache
from hashlib import md5
from zlib import crc32

import numpy as np

from ..functions import patterns as P

#: A text and the counters of the edit; what is no counter stands under "details".
Result = tuple[str, dict]


@lru_cache(maxsize=None)
def rx(pattern: str, flags: int = 0) -> re.Pattern[str]:
    return re.compile(pattern, flags)


CODE = r"```[\s\S]*?```|`[^`\n]+`"
MATH = r"\$\$[\s\S]*?\$\$|\$[^$\n]+\$"
FENCE = r"```[\s\S]*?```"


def tidy(text: str) -> str:
    """At most one blank line in a row, none at the ends."""
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def tokens(text: str) -> int:
    return max(1, len(text) // 4) if text else 0


def apart(text: str, zones: str, edit) -> str:
    """text with edit applied to the parts between the zones."""
    out, at = [], 0
    for m in rx(zones).finditer(text):
        out += [edit(text[at : m.start()]), m.group()]
        at = m.end()
    return "".join([*out, edit(text[at:])])


class Zones:
    """Spans sorted by start, asked whether they meet an interval."""

    def __init__(self, text: str, pattern: str, flags: int = 0):
        self.starts, self.ends = [], []
        for m in rx(pattern, flags).finditer(text):
            self.starts.append(m.start())
            self.ends.append(m.end())

    def meets(self, start: int, end: int) -> bool:
        k = bisect_right(self.starts, end - 1)
        return k > 0 and self.ends[k - 1] > start


# Equations.


def shield(text: str, kinds: dict[str, bool]) -> tuple[str, dict[str, str], dict[str, int]]:
    """Replace equations with placeholders: families in order of priority, the first of overlapping finds wins."""
    taken: list[tuple[int, int, str]] = []
    counts: Counter[str] = Counter()
    for kind, pattern in P.EQUATIONS.items():
        if not kinds.get(kind, kind != "sub_super"):
            continue
        busy = sorted(taken)
        starts = [s for s, _, _ in busy]
        for m in rx(pattern).finditer(text):
            k = bisect_right(starts, m.end() - 1)
            if m.group() and not (k and busy[k - 1][1] > m.start()):
                taken.append((m.start(), m.end(), f"⟦EQ_{len(taken):04d}⟧"))
                counts[kind] += 1
    out, at, kept = [], 0, {}
    for start, end, mark in sorted(taken):
        kept[mark] = text[start:end]
        out += [text[at:start], mark]
        at = end
    return "".join([*out, text[at:]]), kept, dict(counts)


def unshield(text: str, kept: dict[str, str]) -> Result:
    """Put equations back; marks without an equation stay and are counted."""
    back = Counter()

    def put(m: re.Match[str]) -> str:
        known = m.group() in kept
        back["restored" if known else "unknown"] += 1
        return kept[m.group()] if known else m.group()

    out = rx(r"⟦EQ_\d{4,}⟧").sub(put, text)
    return out, {"restored": back["restored"], "orphaned": sum(k not in text for k in kept)}


# Sections.


def headings(rows: list[str], titles: dict[str, str], ocr: bool, setext: bool, longest: int, entries: bool) -> list[tuple[int, int, int, str]]:
    """(first line, first line of the content, level, title group) of headings with a listed title, in order.

    Level 0 is a plain line. A plain line that looks like a list or reference entry is none where entries holds.
    """
    out = []
    for i, row in enumerate(rows):
        m = rx(r"^\s*(#{1,6})\s+(.+?)\s*(?:#+\s*)?$").match(row)
        if m:
            group = titles.get(title(m[2]))
            if group:
                out.append((i, i + 1, len(m[1]), group))
            continue
        plain = row.strip()
        if not plain:
            continue
        group = titles.get(title(plain))
        if not group:
            continue
        under = rows[i + 1].rstrip() if i + 1 < len(rows) else ""
        if setext and rx(r"={3,}|-{3,}").fullmatch(under):
            out.append((i, i + 2, 1 if under[0] == "=" else 2, group))
        elif ocr and len(plain) <= longest and not (entries and any(rx(p).match(plain) for p in P.ENTRIES)):
            out.append((i, i + 1, 0, group))
    return out


def title(text: str) -> str:
    """A heading's text for lookup."""
    text = re.sub(r"^[\s*_]+|[\s*_]+$", "", unicodedata.normalize("NFKC", text))
    return re.sub(r":\s*$", "", text).strip().lower()


def section_end(rows: list[str], start: int, level: int, stops: frozenset[str]) -> int:
    """The line where a section's content ends: the next heading of its level or above, or the end."""
    for i in range(start, len(rows)):
        m = rx(r"^\s*(#{1,6})\s+(.+?)\s*(?:#+\s*)?$").match(rows[i])
        if m and (level == 0 or len(m[1]) <= level):
            return i
        if m or not rows[i].strip():
            continue
        under = rows[i + 1].rstrip() if i + 1 < len(rows) else ""
        if rx(r"={3,}").fullmatch(under) or (level in (0, 1, 2) and level != 1 and rx(r"-{3,}").fullmatch(under)):
            return i
        if level == 0 and title(rows[i]) in stops:
            return i
    return len(rows)


def count_entries(rows: list[str]) -> int:
    """Reference entries: those of the commonest form if there are two, else paragraphs."""
    most = max(sum(bool(rx(p).match(r)) for r in rows) for p in P.ENTRIES)
    if most >= 2:
        return most
    return sum(1 for p in re.split(r"\n\s*\n", "\n".join(rows)) if p.strip())


def drop_sections(text: str, titles: dict[str, str], stops: frozenset[str], mode: str, summary: str, ocr: bool, setext: bool, longest: int, entries: bool) -> Result:
    """Remove or summarise sections by title; sections inside a found one are part of it."""
    rows = text.splitlines()
    found, about, at = [], [], 0
    for first, content, level, group in headings(rows, titles, ocr, setext, longest, entries):
        if first >= at:
            at = section_end(rows, content, level, stops)
            found.append((first, content, at, group))
            of = {"heading": rows[first].strip(), "level": level, "group": group, "start_line": first, "end_line": at, "content_lines": sum(bool(r.strip()) for r in rows[content:at])}
            about.append(of | ({"entry_count": count_entries(rows[content:at])} if entries else {}))
    metrics = Counter({"sections_found": len(found), "entries": sum(s.get("entry_count", 0) for s in about), "lines_affected": sum(e - f for f, _, e, _ in found)})
    metrics.update(f"group_{g}" for _, _, _, g in found)
    details = {"details": {"sections": about}}
    if not found or mode == "keep":
        return text, dict(metrics) | details
    out, at = [], 0
    for first, content, end, group in found:
        out += rows[at:first]
        if mode == "summarize":
            out += ["", summary.format(count=count_entries(rows[content:end]), group=group.replace("_", " ").capitalize()), ""]
        metrics["lines_removed"] += end - first
        at = end
    return tidy("\n".join(out + rows[at:])), dict(metrics) | details


# Tables.


def cells(row: str) -> list[str]:
    return [c.strip() for c in row.strip()[1:-1].split("|")]


def tables(rows: list[str]) -> list[tuple[int, int, list[str], list[list[str]]]]:
    """(first line, end, headers, rows) of pipe tables: a header, a separator and rows under it.

    Cells keep their place: a row is filled up or cut to the number of headers.
    """
    out, i = [], 0
    while i + 2 < len(rows):
        if all(rx(P.TABLE_ROW).match(rows[k]) for k in (i, i + 1, i + 2)) and all(rx(P.SEPARATOR_CELL).match(c) for c in cells(rows[i + 1]) if c) and any(cells(rows[i + 1])):
            end = i + 2
            while end < len(rows) and rx(P.TABLE_ROW).match(rows[end]):
                end += 1
            head = [c for c in cells(rows[i]) if c]
            body = [(cells(r) + [""] * len(head))[: len(head)] for r in rows[i + 2 : end]]
            if head:
                out.append((i, end, head, body))
            i = end
        else:
            i += 1
    return out


def scientific(rows: list[str], first: int, end: int, head: list[str]) -> bool:
    """Statistics in the table, units in its headers, or a caption above it."""
    if rx(P.SCIENTIFIC, re.I).search("\n".join(rows[first:end])) or rx(P.UNIT, re.I).search(" ".join(head)):
        return True
    above = next((r for r in reversed(rows[:first]) if r.strip()), "")
    return bool(rx(P.CAPTION, re.I).search(above))


def compress_table(head: list[str], body: list[list[str]], kv: str = "=", column: str = "|") -> str:
    """Two columns as key-value lines, more as separated lines."""
    if len(head) == 2:
        return "\n".join(["".join(head) + ":", *(f"{a}{kv}{b}" for a, b in body)])
    return "\n".join([column.join(head) + ":", *(column.join(r) for r in body)])


def list_table(head: list[str], body: list[list[str]], nested: bool = True) -> str:
    """Two columns as a list of pairs, more as nested or flat lists."""
    if len(head) == 1:
        return "\n".join([f"{head[0]}:", *(f"- {r[0]}" for r in body)])
    if len(head) == 2:
        return "\n".join([f"{head[0]} ({head[1]}):", *(f"- {a}: {b}" for a, b in body)])
    if nested:
        return "\n".join([f"{head[0]}:", *(line for r in body for line in (f"- {r[0]}:", *(f"  - {h}: {v}" for h, v in zip(head[1:], r[1:]))))])
    return "\n".join([f"{head[0]}:", *(f"- {r[0]}: " + ", ".join(f"{h}={v}" for h, v in zip(head[1:], r[1:])) for r in body)])


def malformed(rows: list[str], known: list[tuple]) -> list[tuple[int, int, list[str], list[list[str]]]]:
    """Runs of two and more pipe lines outside the known tables, separators dropped, all as wide as the widest."""
    busy = {i for first, end, *_ in known for i in range(first, end)}
    out, i = [], 0
    while i < len(rows):
        end = i
        while end < len(rows) and end not in busy and rx(P.PIPE_LINE).match(rows[end]):
            end += 1
        if end - i >= 2:
            body = [c for c in (cells(r) for r in rows[i:end]) if not all(rx(P.SEPARATOR_CELL).match(x) for x in c if x) or not any(c)]
            wide = max((len(c) for c in body), default=0)
            body = [c + [""] * (wide - len(c)) for c in body]
            if len(body) >= 2 and wide:
                out.append((i, end, body[0], body[1:]))
        i = max(end, i + 1)
    return out


def rewrite_tables(text: str, least: int, most: int, keep_scientific: bool, render, repair: bool = False) -> Result:
    """Replace tables that pass the guards by what render makes of them."""
    rows = text.split("\n")
    found = tables(rows)
    broken = malformed(rows, found) if repair else []
    out, at = [], 0
    metrics = Counter(tables_found=len(found), malformed=len(broken))
    for first, end, head, body in sorted([*found, *broken]):
        if len(body) < least or len(head) > most:
            metrics["skipped"] += 1
            continue
        if keep_scientific and scientific(rows, first, end, head):
            metrics["scientific"] += 1
            continue
        out += [*rows[at:first], render(head, body)]
        at = end
        metrics["rewritten"] += 1
    if not metrics["rewritten"]:
        return text, dict(metrics)
    return tidy("\n".join(out + rows[at:])), dict(metrics)


# Pages.


@lru_cache(maxsize=1 << 14)
def letters(text: str) -> Counter[str]:
    return Counter(text)


def alike(a: str, b: str, threshold: float) -> bool:
    """Whether the matching blocks of two strings make up enough of them; lengths and letters are compared first."""
    total = len(a) + len(b)
    if not total:
        return True
    if 2 * min(len(a), len(b)) < threshold * total or 2 * (letters(a) & letters(b)).total() < threshold * total:
        return False
    return SequenceMatcher(None, a, b).ratio() >= threshold


def common(places: dict[str, int], n: int, other: str) -> int:
    """Length of the longest common subsequence of a string of n characters, given as bits by character, and another.

    Matching blocks are a common subsequence, so this bounds what they can add up to.
    """
    ones = (1 << n) - 1
    row, at = ones, places.get
    for c in other:
        hit = row & at(c, 0)
        row = (row + hit) | (row - hit)
    return n - (row & ones).bit_count()


def grouped(keys: list[str], threshold: float | None) -> list[list[str]]:
    """Keys in order, each joined to the first group with a member alike; no threshold: each alone.

    Letters are counted in 64 bins beforehand; what two strings share of these, then of their pairs of neighbouring letters, and then
    their longest common subsequence, bound what they can have in common, so the sequence matcher only sees pairs that may be alike.
    Of strings with T characters together, of which M match on either side, each that doesn't costs a pair of either string at
    most three: 3 M - T - 1 pairs are common at least.
    """
    if threshold is None:
        return [[k] for k in keys]
    bins = np.zeros((len(keys), 64), np.int32)
    pairs = np.zeros((len(keys), 512), np.uint16 if max(map(len, keys), default=0) < 1 << 16 else np.int32)
    for i, k in enumerate(keys):
        points = np.frombuffer(k.encode("utf-32-le", "replace"), np.uint32)
        bins[i] = np.bincount(points & 63, minlength=64)
        pairs[i] = np.bincount(points[:-1] * 37 + points[1:] & 511, minlength=512)
    size = bins.sum(1)
    groups: list[list[str]] = []
    home = np.zeros(len(keys), np.int64)
    matchers: dict[int, SequenceMatcher] = {}
    places: dict[int, dict[str, int]] = {}

    def close(j: int, key: str) -> bool:
        if j not in places:
            at: dict[str, int] = {}
            for k, x in enumerate(keys[j]):
                at[x] = at.get(x, 0) | 1 << k
            places[j] = at
        if 2 * common(places[j], len(keys[j]), key) < threshold * (len(key) + len(keys[j])):
            return False
        if j not in matchers:
            matchers[j] = SequenceMatcher(None, "", keys[j])
        matchers[j].set_seq1(key)
        return matchers[j].ratio() >= threshold

    for i, key in enumerate(keys):
        may = np.flatnonzero(2 * np.minimum(bins[:i], bins[i]).sum(1) >= threshold * (size[:i] + size[i]))
        may = may[2 * (np.minimum(pairs[may], pairs[i]).sum(1, dtype=np.int64) + size[may] + size[i] + 1) >= 3 * threshold * (size[may] + size[i]) - 1e-6]
        found = next((home[j] for j in may[np.argsort(home[may], kind="stable")] if close(int(j), key)), None)
        if found is None:
            found = len(groups)
            groups.append([])
        home[i] = found
        groups[found].append(key)
    return groups


def fingerprint(line: str) -> str:
    """A line of a page's head or foot without case and page numbers; a mere number has none."""
    text = line.strip()
    if not text or rx(r"\d+").fullmatch(text):
        return ""
    text = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", text).lower())
    text = re.sub(r"\s*[-–—]\s*\d+\s*$|\s*\|\s*\d+\s*$", "", text)
    return re.sub(r"\s+", " ", re.sub(r"page\s+\d+(?:\s+of\s+\d+)?", "", text)).strip()


def drop_page_lines(text: str, p: dict) -> Result:
    """Remove lines that recur at the head or foot of enough pages."""
    rows = text.split("\n")
    delimiter = rx(p["page_delimiter"]) if p["page_delimiter"] else rx(r"^\s*(?:[-*_]{3,}|\f)\s*$")
    pages: list[list[int]] = [[]]
    for i, row in enumerate(rows):
        if delimiter.search(row):
            pages.append([])
        elif row.strip():
            pages[-1].append(i)
    pages = [x for x in pages if x]
    if len(pages) < p["min_pages"]:
        return text, {"skipped": 1, "pages": len(pages)}
    gone: set[int] = set()
    patterns: list[dict] = []
    metrics = Counter(pages=len(pages))
    for zone, pick in (("header", lambda x: x[: p["header_zone_lines"]]), ("footer", lambda x: x[-p["footer_zone_lines"] :])):
        seen: dict[str, tuple[set[int], list[int]]] = {}
        for n, page in enumerate(pages):
            for i in pick(page):
                key = fingerprint(rows[i])
                if key:
                    at = seen.setdefault(key, (set(), []))
                    at[0].add(n)
                    at[1].append(i)
        groups = grouped(sorted(seen, key=lambda k: (-len(k), k)), p["fuzzy_threshold"] if p["fuzzy_matching"] else None)
        for group in groups:
            on = set().union(*(seen[k][0] for k in group))
            at = sorted(i for k in group for i in seen[k][1])
            example = rows[at[0]].strip()
            if len(on) / len(pages) < p["min_frequency_ratio"] or not p["min_line_length"] <= len(example) <= p["max_line_length"]:
                continue
            if p["preserve_md_headings"] and rx(r"#{1,6}\s").match(example):
                continue
            gone.update(at)
            metrics[f"{zone}_patterns"] += 1
            patterns.append({"zone": zone, "example": example, "lines": len(at), "pages": len(on)})
    metrics["lines_removed"] = len(gone)
    details = {"details": {"patterns": patterns}}
    if not gone:
        return text, dict(metrics) | details
    return tidy("\n".join(r for i, r in enumerate(rows) if i not in gone)), dict(metrics) | details


# Paragraphs.


def paragraphs(text: str) -> list[tuple[int, int, str, bool, bool]]:
    """(first line, end, text, is heading, is code); fenced code is one paragraph, to the end if it is not closed."""
    rows = text.split("\n")
    out, i = [], 0
    while i < len(rows):
        if not rows[i].strip():
            i += 1
            continue
        j = i
        if rows[i].lstrip().startswith("```"):
            j = i + 1
            while j < len(rows) and not rows[j].lstrip().startswith("```"):
                j += 1
            j = min(j + 1, len(rows))
            out.append((i, j, "\n".join(rows[i:j]), False, True))
        else:
            while j < len(rows) and rows[j].strip() and not (j > i and rows[j].lstrip().startswith("```")):
                j += 1
            body = "\n".join(rows[i:j])
            under = j - i == 2 and rx(r"={3,}|-{3,}").fullmatch(rows[i + 1].strip())
            out.append((i, j, body, bool(rx(r"#{1,6}\s").match(rows[i].lstrip()) or under), False))
        i = j
    return out


def normal(text: str) -> str:
    text = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", text).lower())
    return re.sub(r"[^\w\s]", "", text).strip()


def hash64(text: str) -> int:
    return int.from_bytes(md5(text.encode("utf-8", "replace")).digest()[:8], "little")


def simhash(text: str) -> int:
    """64 bits of the word 3-grams; fewer words: the hash of the text."""
    w = text.split()
    if len(w) < 3:
        return hash64(text)
    hashes = [hash64(" ".join(w[i : i + 3])) for i in range(len(w) - 2)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def dedup_paragraphs(text: str, p: dict) -> Result:
    """Drop paragraphs that repeat an earlier one: alike in bytes, in normal form, or nearly."""
    rows, gone, metrics = text.split("\n"), set(), Counter()
    seen: dict[int, int] = {}
    kept: list[tuple[int, str, int]] = []
    groups: set[int] = set()
    for first, end, body, is_heading, is_code in paragraphs(text):
        if (is_heading and p["preserve_headings"]) or (is_code and p["preserve_code_blocks"]) or len(body.strip()) < p["min_paragraph_length"]:
            continue
        metrics["checked"] += 1
        form = body if p["mode"] == "exact" else normal(body)
        key = hash64(form)
        like = seen.get(key)
        if like is None and p["mode"] == "fuzzy":
            mark = simhash(form)
            like = next((at for m, other, at in kept if (mark ^ m).bit_count() <= p["max_hamming_distance"] and alike(form, other, p["similarity_threshold"])), None)
            if like is None:
                kept.append((mark, form, first))
        seen.setdefault(key, first if like is None else like)
        if like is not None:
            groups.add(like)
            gone.update(range(first, end))
            metrics["removed"] += 1
    metrics["groups"] = len(groups)
    if not gone:
        return text, dict(metrics)
    return tidy("\n".join(r for i, r in enumerate(rows) if i not in gone)), dict(metrics)


def dedup_semantic(text: str, p: dict, embed) -> Result:
    """Drop paragraphs close to an earlier seed in the embedding; of each cluster one stays."""
    parts = paragraphs(text)
    able = [k for k, x in enumerate(parts) if len(x[2].strip()) >= p["min_paragraph_length"] and not (x[3] and p["preserve_headings"]) and not (x[4] and p["preserve_code_blocks"])]
    if len(able) < 2:
        return text, {"eligible": len(able)}
    vectors = np.asarray(embed([parts[k][2] for k in able]), np.float32)
    gone: set[int] = set()
    open_ = np.ones(len(able), bool)
    for i in range(len(able)):
        if not open_[i]:
            continue
        near = [j for j in np.flatnonzero(vectors[i:] @ vectors[i] >= p["similarity_threshold"]) + i if open_[j]]
        near = sorted({i, *map(int, near)})
        open_[near] = False
        keep = max(near, key=lambda j: (len(parts[able[j]][2]), -j)) if p["representative_strategy"] == "longest" else near[0]
        gone.update(able[j] for j in near if j != keep)
    return "\n\n".join(x[2] for k, x in enumerate(parts) if k not in gone), {"eligible": len(able), "removed": len(gone)}


def hashed_embedding(texts: list[str], width: int = 256) -> list[list[float]]:
    """Unit vectors of hashed words and word pairs: an embedding that needs no model."""
    out = []
    for text in texts:
        w = normal(text).split()
        v = [0.0] * width
        for gram in [*w, *(" ".join(x) for x in zip(w, w[1:]))]:
            h = crc32(gram.encode("utf-8", "replace"))
            v[h % width] += 1.0 if h >> 31 else -1.0
        norm = sum(x * x for x in v) ** 0.5 or 1.0
        out.append([x / norm for x in v])
    return out


# Abbreviations.


def abbreviate(text: str, p: dict) -> Result:
    """Replace frequent capitalised phrases by acronyms, the first occurrence introducing them."""
    zones = "|".join([*([CODE] if p["protect_code"] else []), *([r"(?m:^#{1,6}\s+.*$)"] if p["protect_headings"] else [])]) or r"(?!)"
    busy, counts, first = Zones(text, zones), Counter(), {}
    for m in rx(P.PHRASE).finditer(text):
        phrase = re.sub(r"\s+", " ", m[1])
        if not busy.meets(m.start(), m.end()) and sum(w.lower() not in P.CONNECTORS for w in phrase.split()) >= p["min_words"]:
            counts[phrase] += 1
            first.setdefault(phrase, m.start())
    existing = set(rx(P.ACRONYM).findall(text))
    most = max(counts.values(), default=1)
    best: dict[str, tuple] = {}
    for phrase, n in counts.items():
        short = "".join(w[0] for w in phrase.split() if w.lower() not in P.CONNECTORS).upper()
        if n < p["min_frequency"] or not p["min_acronym_length"] <= len(short) <= p["max_acronym_length"] or short in existing:
            continue
        size = len(phrase.split())
        sure = round(0.5 * n / most + 0.3 * min(1, size / 3) + 0.2 * min(1, (len(phrase) - size) / 20), 3)
        if sure >= p["min_confidence"] and (short not in best or (n, -first[phrase]) > best[short][:2]):
            best[short] = (n, -first[phrase], phrase)
    metrics = Counter(candidates=len(counts), chosen=len(best))
    for short, (_, _, phrase) in sorted(best.items(), key=lambda x: (-len(x[1][2]), x[0])):
        busy, done, out, at = Zones(text, zones), 0, [], 0
        found = [m for m in rx(r"(?<![A-Za-z0-9])" + r"\s+".join(map(re.escape, phrase.split())) + r"(?![A-Za-z0-9])").finditer(text) if not busy.meets(m.start(), m.end())]
        if len(found) < 2:
            continue
        for m in found:
            out += [text[at : m.start()], p["intro_format"].format(phrase=phrase, acronym=short) if not done else short]
            at, done = m.end(), done + 1
        text = "".join([*out, text[at:]])
        metrics["replaced"] += done - 1
    return text, dict(metrics)


# Importance.


def tier(heading: str, body: str) -> int:
    """1 essential, 2 ordinary, 3 expendable: by heading, else by content."""
    for level, pattern in ((1, P.TIER1), (3, P.TIER3), (2, P.TIER2)):
        if heading and rx(pattern, re.I).search(heading):
            return level
    if rx(P.EQUATION_SIGN).search(body) or rx(P.DEFINITION_SIGN, re.I).search(body) or rx(P.ALGORITHM_SIGN, re.I).search(body):
        return 1
    return 3 if rx(P.BOILERPLATE_SIGN, re.I).search(body) else 2


def sections(text: str) -> list[tuple[str, str]]:
    """(heading line or "", text with it): a new section at every heading line."""
    at = [m.start() for m in rx(r"^#{1,6}\s+.+$", re.M).finditer(text)]
    ends = [*at, len(text)]
    out = [("", text[: at[0]])] if at and at[0] > 0 else [] if at else [("", text)]
    return out + [(text[a:b].split("\n", 1)[0], text[a:b]) for a, b in zip(at, ends[1:])]


def moderate(body: str, citations: bool, fillers: bool) -> str:
    if citations:
        body = rx(P.TIER_CITATION).sub("", body)
    if fillers:
        for pattern, new in P.FILLERS:
            body = rx(pattern, re.I).sub(new, body)
    return re.sub(r"[ \t]{2,}", " ", body)


def aggressive(body: str) -> str:
    """Headings and the first line with text under each."""
    out, open_ = [], True
    for row in body.split("\n"):
        if rx(r"#{1,6}\s").match(row):
            out, open_ = [*out, row], True
        elif row.strip() and open_:
            out, open_ = [*out, row], False
    return "\n".join(out)


def by_importance(text: str, p: dict) -> Result:
    """Rewrite each section by its tier's action."""
    out, metrics = [], Counter()
    for heading, body in sections(text):
        level = tier(re.sub(r"^#{1,6}\s+", "", heading), body)
        metrics[f"tier{level}"] += 1
        action = p[f"tier{level}_action"]
        if level == 3 and p["remove_tier3"]:
            metrics["removed"] += 1
            continue
        out.append(body if action == "preserve" else moderate(body, p["compress_citations_tier2"], p["compress_redundant_tier2"]) if action == "moderate" else aggressive(body) + "\n\n")
    return tidy("".join(out)), dict(metrics)

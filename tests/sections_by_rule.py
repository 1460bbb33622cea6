"""The rules of splitting, one block after another: what the windows of operators/sections.py are held against."""

import re

from lectern.operators.sections import PREAMBLE, REF_CHARS, Rules

_CLOSED = re.compile(r"[.;:,!?)\]»”\"]$")


def _view(b) -> str:
    text = "#" * b.level + " " + b.text if b.level else b.text
    return "> " + text if b.quoted else text


def _titled(text: str) -> bool:
    return len(text) <= 150 and not _CLOSED.search(text) and not text[:1].islower()


def sections_of(blocks: list, rules: Rules) -> list[tuple[str, tuple[str, ...], str]]:
    """(ref, heading path, text) of each section of one document; blocks have text, level, ref, page, quoted."""
    views = [_view(b) for b in blocks]
    begin, stop = 0, len(blocks)
    if rules.body_start is not None:
        begin = next((i for i, v in enumerate(views) if re.match(rules.body_start, v)), -1)
        if begin < 0:
            raise ValueError(f"no line begins the body (body_start {rules.body_start!r})")
    if rules.body_end is not None:
        stop = next((i for i, v in enumerate(views) if i > begin and re.match(rules.body_end, v)), -1)
        if stop < 0:
            raise ValueError(f"no line ends the body (body_end {rules.body_end!r})")
    blocks, views = blocks[:stop], views[:stop]
    by_pattern = False
    if any(b.ref for b in blocks):
        start = lambda i: blocks[i].ref
    elif rules.section_pattern:
        by_pattern = True

        def start(i: int) -> str | None:
            m = re.match(rules.section_pattern, views[i])
            return m and (m.expand(rules.section_label) if rules.section_label else m["ref"])
    elif any(b.level for b in blocks):
        start = lambda i: blocks[i].text[:REF_CHARS] if blocks[i].level else None
    else:

        def start(i: int) -> str | None:
            page = blocks[i].page
            before = blocks[i - 1].page if i > begin else None
            return f"p. {page}" if page is not None and page != before else None

    refs = [start(i) if i >= begin else None for i in range(len(blocks))]
    chapters = [re.match(rules.chapter_pattern, v) if rules.chapter_pattern and i >= begin else None for i, v in enumerate(views)]
    heads = [refs[i] is None and bool(b.level or chapters[i]) for i, b in enumerate(blocks)]
    # anchors, from the end; a heading with nothing after it stays in the last section
    counts, n = [], 0
    for r in refs:
        n += r is not None
        counts.append(n)
    place, ahead = [0] * len(blocks), n
    for i in range(len(blocks) - 1, -1, -1):
        if not heads[i]:
            ahead = counts[i]
        place[i] = ahead
    texts: list[list[str]] = [[] for _ in range(n + 1)]
    for i, b in enumerate(blocks):
        texts[place[i]].append(b.text)
    # headings as a tree: each knows the nearest one before it that is higher; a chapter line without a level is a new root
    tree: list[tuple[int, str, int]] = []
    last = -1

    def above(k: int, level: int) -> int:
        while k >= 0 and tree[k][0] >= level:
            k = tree[k][2]
        return k

    def titles(k: int) -> tuple[str, ...]:
        found: list[str] = []
        while k >= 0:
            found.insert(0, tree[k][1])
            k = tree[k][2]
        return tuple(found)

    named: list[tuple[str, tuple[str, ...]]] = [(PREAMBLE, ())]
    chapter = rules.first_chapter
    for i, b in enumerate(blocks):
        opens = chapters[i]
        if opens:
            chapter = opens.expand(rules.chapter_label) if rules.chapter_label else opens["ref"]
        parent = above(last, b.level) if b.level else -1 if opens else last
        if refs[i] is not None:
            k, own = counts[i], refs[i]
            named.append((own if not chapter or own.startswith(chapter) else " ".join((chapter, own)), titles(parent)))
            # in pattern mode a title line just before a number belongs to it
            if by_pattern and not (i and heads[i - 1]) and (k > 1 or texts[0]) and len(texts[k - 1]) > 1 and _titled(texts[k - 1][-1]):
                texts[k].insert(0, texts[k - 1].pop())
        if b.level or opens:
            tree.append((b.level or 1, b.text, parent))
            last = len(tree) - 1
    out, seen = [], {}
    for k, (ref, heading_path) in enumerate(named):
        if k == 0 and not texts[0]:
            continue
        seen[ref] = seen.get(ref, 0) + 1
        ref = ref if seen[ref] == 1 else f"{ref} ({seen[ref]})"
        parts, size = [[]], 0
        for t in texts[k]:
            if parts[-1] and size + len(t) > rules.max_chars:
                parts.append([])
                size = 0
            parts[-1].append(t)
            size += len(t) + 1
        for p, lines in enumerate(parts, 1):
            out.append((ref if len(parts) == 1 else f"{ref} (part {p})", heading_path, "\n".join(lines)))
    return [s for s in out if not (rules.drop_preamble and s[0].startswith(PREAMBLE))]

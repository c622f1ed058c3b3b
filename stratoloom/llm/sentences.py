"""Sentence boundaries across languages and scripts.

A text is first parted into units (paragraphs, list lines, headings).  Gaps within quotations and
brackets cannot end the sentence that holds them.

Spaced scripts: the gaps behind the terminators of a unit are a lattice with two ways through each,
ending there and going on.  The word before a gap (abbreviation, initial, number) and the opening word
behind it (case, kind, words that begin sentences) are the costs of the two, a piece that holds no word
costs as well, and the cheapest path is taken.  Spaceless scripts: the text on both sides of a gap is
segmented by the cheapest path through a lattice of dictionary words; the terminator, the particle
before the gap and the opening word behind it give the costs of ending there and of going on, and the
cheaper way is taken.  Thai: a space ends a sentence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import map_frames

# Abbreviations after which a sentence usually goes on, lower case, without the last point.
#: Stand before a name or number, so that a capital behind them proves nothing.
BEFORE_NAME = frozenset(
    "dr prof mr mrs ms st sr sra dra srta m mme mlle no nr nos fig figs p pp pág págs abs art bd vol ch chap cap sec eq ref cf vgl z.b u.a"
    " hr fr núm ed eds capt gen sen rep gov lt col sgt vs v bzw d.h e.g i.e p.ex s.o s.u ggf inkl evtl zzgl ca approx aprox env डॉ श्री प्रो".split()
)
#: May also stand at the end of a sentence: a capital or quotation behind them ends it.
MAY_END = frozenset("etc inc ltd corp co usw jr a.m p.m u.s u.k ee.uu al".split())

#: Of these, those that mostly stand before a name: only a word that opens sentences ends one there.
OF_A_NAME = frozenset("u.s u.k ee.uu jr".split())
#: Words that open sentences and begin no name, lower case, of the spaced Latin scripts.
OPENERS = frozenset(
    "the this that these those it he she they we you there then but and so if when while after before because however in on at for as i"
    " der die das dies es er sie wir ihr dann aber und wenn als nach doch hier le la les un une ce cette il elle nous vous ils puis mais et si quand après"
    " el los las una este esta eso él ella nosotros ellos luego pero y cuando después".split()
)
#: Stand before a German ordinal number, which is written with a point.
ORDINAL_BEFORE = frozenset("der die das dem den des am vom zum im ins ein eine einen einem einer bis seit ab und".split())
TERMINATORS = ".!?…।॥؟。！？．"
OPENING = {"“": "”", "«": "»", "„": "“", "(": ")", "[": "]", "「": "」", "『": "』", "（": "）", "《": "》", "【": "】", "‹": "›"}
CLOSING = frozenset("”»“)]」』）》】›\"'’")
_THAI = re.compile(r"[฀-๿]")
_DEVANAGARI = re.compile(r"[ऀ-ॿ]")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")
_GAP_SPACED = re.compile(r"[.!?…।॥؟]+")
_GAP_CJK = re.compile(r"[。！？…!?．]+|\.(?!\w)")
_INITIAL = re.compile(r"[^\W\d_]\.")
_LIST_LINE = re.compile(r"- ")
_HEADING = re.compile(r"#{1,6}(?:\s|$)")

# Words of the spaceless scripts that decide about a gap.
JA_QUOTING = frozenset("と って との という といった とだけ とも などと と言う と言った と述べた".split())
ZH_SPEECH = frozenset("说 问 答 喊 写道 说道 问道 回答 表示 补充 的 是 和 这 这句话 之后 时 等".split())
JA_WORDS = frozenset("は が を に で と の も へ から まで より です ます した する いる ない だけ 書いた 言った 尋ねた のか か よ ね ください".split()) | JA_QUOTING
ZH_WORDS = frozenset("的 了 吗 呢 吧 啊 我们 请 为什么 版本 参见 耗时 因为 没有 索引 队列 日志 任务 主题 向量 快照 摘要 仓库 报告 检索".split()) | ZH_SPEECH
#: Particles that end a sentence, and words after which one goes on.
FINAL_PARTICLES = frozenset("か よ ね のか です ます した ください 吗 呢 吧 啊 了".split())
OPEN_PARTICLES = frozenset("は が を に で と の も へ から まで より 的 和 是 因为".split())
#: Words that open a sentence; the lattice keeps the particles they begin with from being seen.
JA_OPENING = frozenset("しかし でも だから そして また では ところで とても とにかく とりあえず となり もし もちろん はい はじめ がんばって".split())
ZH_OPENING = frozenset("但是 然后 所以 因为 不过 我们 他们 如果 请 为什么 是的 的确 和平 了解".split())
#: Costs of (ending, going on) at a terminator: a full stop is certain, points of omission hardly say anything.
STOP, ASKING, OMISSION = (0.0, 5.0), (0.0, 2.0), (1.0, 1.5)


def segment(text: str, words: frozenset[str], longest: int = 6) -> list[str]:
    """The cheapest path through the lattice of dictionary words over the text.

    A dictionary word costs 1, a run of other characters of one class 1 plus a tenth a character
    for Latin letters and digits and 2 for each other character; ties go to the longer last word.
    """
    n = len(text)
    best: list[tuple[float, int]] = [(0.0, 0)] + [(float("inf"), 0)] * n
    for i in range(n):
        cost = best[i][0]
        for j in range(i + 1, min(n, i + longest) + 1):
            if text[i:j] in words and cost + 1 < best[j][0]:
                best[j] = (cost + 1, i)
        j = i + 1
        if text[i].isascii() and text[i].isalnum():
            while j < n and text[j].isascii() and (text[j].isalnum() or text[j] in "._/-"):
                j += 1
            if cost + 1 + 0.1 * (j - i) < best[j][0]:
                best[j] = (cost + 1 + 0.1 * (j - i), i)
        if cost + 2 < best[i + 1][0]:
            best[i + 1] = (cost + 2, i)
    out, j = [], n
    while j:
        i = best[j][1]
        out.append(text[i:j])
        j = i
    return out[::-1]


_MARKS = frozenset("。！？…!?．、，；：\n")
_STRETCH_AFTER = re.compile(r"[^。！？…!?．\n]*")


def _gap_ends(before: str, mark: str, after: str, japanese: bool) -> bool:
    """Whether the cheaper way at a gap between sentences of a spaceless script is to end there.

    No word holds a mark of punctuation, so the lattices of the stretches up to the next ones are
    those of the whole text.
    """
    end, on = OMISSION if set(mark) <= {"…"} else ASKING if mark[-1] in "？！?!…" else STOP
    words = JA_WORDS | JA_OPENING if japanese else ZH_WORDS | ZH_OPENING
    tail, head = segment(before, words)[-1:], segment(after, words)[:1]
    if mark[-1] == "…":
        if after[:1] and after[0] in "，、；：":
            return False
        if tail and tail[0] in FINAL_PARTICLES:
            on += 2
        elif tail and tail[0] in OPEN_PARTICLES:
            end += 2
    if head and head[0] in (JA_OPENING if japanese else ZH_OPENING):
        on += 2
    elif head and japanese and head[0] in (JA_QUOTING if mark[-1] != "…" else JA_QUOTING | OPEN_PARTICLES):
        end += 3
    elif head and not japanese and mark[-1] == "…" and head[0] in ("的", "吗", "呢", "吧", "啊"):
        end += 3
    return end <= on


def units(text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, whole) of the units; whole ones (list lines, headings) are sentences as they are."""
    start = None
    pos = 0
    for line in re.findall(r"[^\n]*\n|[^\n]+", text):
        end = pos + len(line)
        bare = line.strip()
        if not bare or _LIST_LINE.match(line) or _HEADING.match(line):
            if start is not None:
                yield start, pos, False
                start = None
            if bare:
                yield pos, end, True
        elif start is None:
            start = pos
        pos = end
    if start is not None:
        yield start, pos, False


def quotations(s: str) -> list[tuple[int, int]]:
    """Outermost (opening, closing) places of matched quotation marks and brackets."""
    spans, stack = [], []
    for m in re.finditer(r"[“”«»„()\[\]「」『』（）《》【】‹›\"]", s):
        c, i = m[0], m.start()
        if c == '"':
            if any(o == '"' for o, _ in stack):
                while stack:
                    o, at = stack.pop()
                    if o == '"':
                        break
                if not stack:
                    spans.append((at, i))
            elif s[i + 1 : i + 2].strip():
                stack.append((c, i))
            continue
        wanted = [k for k, (o, _) in enumerate(stack) if OPENING.get(o) == c]
        if wanted:
            at = stack[wanted[-1]][1]
            del stack[wanted[-1] :]
            if not stack:
                spans.append((at, i))
        elif c in OPENING:
            stack.append((c, i))
    # what lies within an opening mark that nothing closes
    if stack:
        inner = quotations_after(s, stack[0][1] + 1)
        spans = [x for x in spans if x[1] < stack[0][1]] + inner
    return spans


def quotations_after(s: str, start: int) -> list[tuple[int, int]]:
    """As :func:`quotations`, for the rest of the text behind an opening mark without its partner."""
    return [(a + start, b + start) for a, b in quotations(s[start:])]


def _last_word(s: str, i: int) -> str:
    """The word (points within it included) that ends just before ``i``."""
    j = i
    while j and not s[j - 1].isspace() and s[j - 1] not in "(“„«\"'[,;:":
        j -= 1
    return s[j:i]


#: (ending, going on): certain ends, certain passages, and ends or passages unless something else speaks against them.
ENDS, PASSES, MAY_END_HERE, MAY_PASS = (0.0, 6.0), (6.0, 0.0), (1.0, 2.0), (3.0, 0.0)
#: What an opening word adds to going on, and a piece without a word to its end.
OPENER_COST, NO_WORD_COST = 4.0, 2.5
_OPENING_WORD = re.compile(r"[\"'“«„¿¡(\[‹]*([^\W\d_]+)")
_TWO_LETTERS = re.compile(r"[^\W_]{2}|\d")


def _gap_costs(s: str, at: int, stop: int, nxt: int) -> tuple[float, float]:
    """What it costs to end a sentence at the terminators s[at:stop], and to go on to the visible character at ``nxt``."""
    run = s[at:stop]
    if run[-1] in "।॥؟" or run != "." and _DEVANAGARI.search(s[max(0, at - 12) : at]):
        return ENDS
    word = _last_word(s, at)
    first = s[nxt]
    opens = first in "¿¡“«„\"([‹" or first.isupper() or first.istitle() or first.isdigit() or first.isalpha() and first.lower() == first.upper()
    if run != ".":
        # several points, or a question or exclamation: a small letter behind them goes on
        return ENDS if opens and not (first.isdigit() and run[-1] in ".…") else PASSES
    m = _OPENING_WORD.match(s, nxt)
    opener = OPENER_COST if m and m[1].istitle() and m[1].lower() in OPENERS else 0.0
    stem = word.lower().rstrip(".")
    if stem in MAY_END:
        if not opens or first.isdigit():
            return PASSES
        end, on = MAY_PASS if stem in OF_A_NAME else MAY_END_HERE
        return end, on + opener
    if stem in BEFORE_NAME:
        return PASSES
    if len(stem) == 1 and stem.isalpha() and word[:1].isupper():
        # an initial, unless a word that begins no name follows
        return MAY_PASS[0], MAY_PASS[1] + (opener if m and len(m[1]) > 1 else 0.0)
    if stem.isdigit() and len(stem) <= 2:
        before = _last_word(s, len(s[: at - len(word)].rstrip()))
        if before.lower() in ORDINAL_BEFORE or not before and not opens:
            return PASSES  # an ordinal number
    if len(stem) == 1 and stem.isalpha() and _INITIAL.match(s, nxt):
        return PASSES  # the first half of an abbreviation in two parts
    if "." in stem and all(len(x) == 1 for x in stem.split(".")):
        return PASSES
    return ENDS if opens else PASSES


def _cheapest_ends(s: str, gaps: list[tuple[int, float, float]]) -> list[int]:
    """The gaps (place, cost of ending, cost of going on) at which the cheapest path ends a sentence.

    The state is the last end, as a piece without a word costs: the path of each is kept.
    """
    if all((e, o) in (ENDS, PASSES) for _, e, o in gaps):
        return [p for p, e, o in gaps if e < o]
    # by last end: cost and the ends before it
    best: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}
    for place, end, on in gaps:
        cost, last = min((c + (0.0 if _TWO_LETTERS.search(s, a, place) else NO_WORD_COST), a) for a, (c, _) in best.items())
        ended = (cost + end, (last, best[last][1]))
        best = {a: (c + on, way) for a, (c, way) in best.items()}
        best[place] = ended
        # no piece of the future can make up for more than a piece without a word
        least = min(c for c, _ in best.values())
        best = {a: x for a, x in best.items() if x[0] <= least + NO_WORD_COST}
    last = min(best, key=lambda a: (best[a][0], -a))
    out, way = [], (last, best[last][1])
    while way is not None:
        if way[0]:
            out.append(way[0])
        way = way[1]
    return out[::-1]


def _split_spaced(s: str) -> list[int]:
    """Places just after the sentences that end within ``s``."""
    spans = quotations(s)
    gaps, k = [], 0
    for m in _GAP_SPACED.finditer(s):
        stop = m.end()
        while k < len(spans) and spans[k][1] < m.start():
            k += 1
        inside = k < len(spans) and spans[k][0] < m.start()
        if inside and s[stop : spans[k][1]].strip() and any(c not in CLOSING for c in s[stop : spans[k][1]].strip()):
            continue
        end = stop
        while end < len(s):
            # French marks stand off their quotation by a space
            step = re.match(r"[\s  ]?([»])|([”“)\]’'\"›])", s[end:])
            if not step or step[2] == "“" and not inside or step[2] == '"' and not inside:
                break
            end += step.end()
            inside = inside and end <= spans[k][1]
        if end < len(s) and not s[end].isspace():
            continue
        nxt = end
        while nxt < len(s) and s[nxt].isspace():
            nxt += 1
        if nxt == len(s):
            break
        if end > stop or not inside:
            gaps.append((end, *_gap_costs(s, m.start(), stop, nxt)))
    return _cheapest_ends(s, gaps)


def _split_cjk(s: str) -> list[int]:
    spans = quotations(s)
    out, k = [], 0
    japanese = re.search(r"[぀-ヿ]", s) is not None
    words = JA_WORDS if japanese else ZH_WORDS
    for m in _GAP_CJK.finditer(s):
        end = m.end()
        while k < len(spans) and spans[k][1] < m.start():
            k += 1
        quoted = False
        if k < len(spans) and spans[k][0] < m.start():
            rest = s[end : spans[k][1]]
            if any(c not in CLOSING for c in rest):
                continue
            end, quoted = spans[k][1] + 1, True
        rest = s[end:].lstrip()
        if not rest:
            break
        if m[0] == "." and rest[0].isascii() and rest[0].islower():
            continue
        if quoted:
            path = segment(_STRETCH_AFTER.match(rest)[0] or rest[0], words)
            head = path[0]
            if japanese:
                if head in JA_QUOTING or head[0] in "とはがをにのもで、":
                    continue
            else:
                if head[0].isascii() and head[0].isalnum() and len(path) > 1:
                    if path[1] in ZH_SPEECH and path[1] not in ("的", "是", "和") and path[2:3] != ["："] and s[spans[k][0] - 1 : spans[k][0]] != "：":
                        continue
                elif head in ZH_SPEECH or head[0] in "，、；的":
                    continue
        else:
            begin = m.start()
            while begin and s[begin - 1] not in _MARKS:
                begin -= 1
            if not _gap_ends(s[begin : m.start()], m[0], _STRETCH_AFTER.match(rest)[0] or rest[0], japanese):
                continue
        out.append(end)
    return out


def _split_thai(s: str) -> list[int]:
    spans = quotations(s)
    out, k = [], 0
    for m in re.finditer(r"\s+", s):
        at = m.start()
        while k < len(spans) and spans[k][1] < at:
            k += 1
        if k < len(spans) and spans[k][0] < at:
            continue
        if "\n" in m[0] and m[0].strip(" ") == "\n" and " " not in m[0]:
            continue  # a line break alone ends no sentence
        out.append(at)
    return out


def sentence_spans(text: str | None) -> list[tuple[int, int]]:
    """(start, end) code points of the sentences of a text in order; none for null or blank texts."""
    out: list[tuple[int, int]] = []
    if not text:
        return out
    for a, b, whole in units(text):
        s = text[a:b]
        if whole:
            cuts = []
        elif _THAI.search(s):
            cuts = _split_thai(s)
        elif _CJK.search(s):
            cuts = _split_cjk(s)
        else:
            cuts = _split_spaced(s)
        at = 0
        for c in [*cuts, len(s)]:
            piece = s[at:c]
            bare = piece.strip()
            if bare:
                start = a + at + len(piece) - len(piece.lstrip())
                out.append((start, start + len(bare)))
            at = c
    return out


def split_sentences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """One row per sentence: ``doc_id, sentence`` (its number from 0), ``start_char, end_char``.

    Offsets are code points from 0, without white space around the sentence.  Works where the rows
    are read, without a shuffle and on whole texts; null, empty and blank texts give no rows,
    repeated rows repeated results, a null id is kept.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")).where("_text is not null")

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for d, t in zip(b["doc_id"], b["_text"], strict=True):
                for n, (s, e) in enumerate(sentence_spans(t)):
                    out.append((d, n, s, e, t[s:e]) if with_text else (d, n, s, e))
            yield pd.DataFrame(out, columns=names)

    names = ["doc_id", "sentence", "start_char", "end_char"] + (["text"] if with_text else [])
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_frames(rows, split, f"doc_id {kind}, sentence int, start_char int, end_char int" + (", text string" if with_text else ""))

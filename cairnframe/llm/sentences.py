"""Sentence units of mails in many languages and scripts, by their places in the stored text."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from cairnframe.llm.mailparts import own_blocks
from cairnframe.llm.tokens import TOKENIZERS, load_ranks, ranks_of

# Words before a dot that a sentence always runs on after.
RUNS_ON = frozenset(
    """
    mr mrs ms dr prof messrs st rev gen col capt lt sgt hon mt no nos vol vols fig figs sec ch pp p vs cf e.g i.e approx
    ca viz ed eds dept est tel ext art nr
    hr fr fa dipl.-ing dipl ing abs bd s vgl z bzw bspw sog ggf evtl inkl str d.h z.b nr.
    ee sr sra srta dra d dña pág págs aprox núm art ej av
    m mm mme mlle me env réf chap av ex n
    г-н г-жа д-р проф см с стр т ул рис табл илл им тел гл напр ср е к
    د أ م ص डॉ श्री प्रो
    """.split()
)
# Those of them that are words too, which end a sentence before an upper-case letter.
WORDS_TOO = frozenset("no nos art est ch sec ex".split())
# Words before a dot that may stand at the end of a sentence, as well as within one.
MAY_END = frozenset(
    """
    etc al a.m p.m u.s u.k u.n e.u jr inc co ltd corp bros jan feb mar apr jun jul aug sep sept oct nov dec mon tue wed
    thu fri sat sun min max usw u.a u.ä ff a.d s.a uu ee.uu suiv sq sqq д п г гг др пр ч мин сек тыс млн млрд руб коп
    """.split()
)
# Words that a German ordinal stands after, and the names of months that one stands before.
ORDINAL_AFTER = frozenset("der die das den dem des am im vom zum zur beim seit bis ab unser unsere jeder jede jedes".split())
MONTHS = re.compile(r"(?:Januar|Jänner|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember)\b")
# Parts of company names that come after a dot.
COMPANY = re.compile(r"(?:KG|KGaA|OHG|AG|SE|Inc|Ltd|Corp|LLC|LLP|PLC|SA|SL|SRL)\b")
# Names of brands and programs that stay in lower case at the start of a sentence.
LOWER_NAMES = re.compile(
    r"(?:iOS|iPad|iPhone|iPod|iCloud|iTunes|eBay|macOS|adidas|jQuery|awk|bash|cmake|cron|curl|emacs|ffmpeg|gcc|git|grep|gzip|kubectl|mysql|nginx|"
    r"npm|numpy|pandas|pip|rsync|scp|sed|sftp|ssh|sudo|systemd|tar|tmux|vim|wget|zsh)\b"
)
# Single dotted letters before the last one that make an abbreviation which may end a sentence.
PAIRS = {("a", "m"), ("p", "m"), ("s", "a"), ("u", "s"), ("ee", "uu"), ("т", "д"), ("т", "п"), ("и", "др"), ("н", "э"), ("u", "a")}
# Classes of words of spaceless scripts. Joining words carry a sentence on after a gap, saying words do so after the name
# of who said a quotation, final particles stand at the end of a sentence, opening words at its beginning; persons do, but also say things.
JOINS = """
と って という といった との が を は に も で へ や など から まで の だけ さえ ので のに けれど けど
却 的 地 得 了 也 就 而 并 是 在 和 与 或 跟 都 还 之后 以后 之前 时 这样 那样
""".split()
SAYS = "说 說 问 問 道 喊 叫 答 写道 表示 回答 说道 问道 笑道 言 言う 言い 言っ 述べ 話し 聞い 聞き 叫ん 答え".split()
FINALS = "吗 嗎 呢 吧 啊 呀 嘛 啦 哦 喔 ね よ か な わ ぞ ぜ です ます でした ました ません ください でしょう".split()
PERSONS = "我 你 您 他 她 它 我们 你们 他们 她们 咱们 私 僕 彼 彼女 彼ら".split()
OPENERS = """
这 那 这个 那个 这里 那里 这些 那些 谁 哪 哪里 什么 怎么 为什么 请 又 再 但是 可是 不过 然而 于是 然后 所以
因此 因为 如果 虽然 而且 并且 另外 其实 也许 可能 大概 大约 昨天 今天 明天 昨晚 今晚 今早 现在 后来 最后 首先 第一 没有 不
これ それ あれ この その あの ここ そこ どこ 誰 何 なぜ そして しかし だから ところで また まず 次に さらに つまり ただ ただし 実は 実際 たぶん
きっと もし もう まだ 昨日 今日 明日 今朝 昨夜 今 はい いいえ では それでは なお 最後に やはり
""".split()
CLASSES = {w: k for k, words in (("opens", OPENERS), ("person", PERSONS), ("final", FINALS), ("says", SAYS), ("joins", JOINS)) for w in words}
#: Cost of a word of the classes, of another word of the dictionary, and of a character that is in no word.
CLASS_COST, WORD_COST, UNKNOWN_COST = 1.0, 1.1, 2.0
_PART = re.compile(r"[^，。！？、；：“”「」『』（）()\s.,!?…]*")
_PART_BEFORE = re.compile(r"[^，。！？、；：“”「」『』（）()\s.,!?…]*\Z")
_SPACELESS = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]{2,8}")


def dictionary(tokens: Iterable[bytes]) -> dict[str, str]:
    """The words of Han and Kana among the tokens of a public vocabulary, with no class, and the words of the classes."""
    out = {}
    for token in tokens:
        try:
            word = token.decode().strip()
        except UnicodeDecodeError:
            continue
        if _SPACELESS.fullmatch(word):
            out[word] = ""
    return out | CLASSES


def words_in(text: str, words: dict[str, str]) -> list[tuple[str, str]]:
    """(class, word) of the best path through the word lattice of a run of text without blanks.

    Every word of the dictionary is an edge, so is every character; the path with the least cost counts, and of equal
    ones that whose first word is longer.
    """
    longest, n = max(map(len, words), default=1), len(text)
    cost, step = [0.0] * (n + 1), [1] * n
    for i in range(n - 1, -1, -1):
        cost[i] = cost[i + 1] + UNKNOWN_COST
        for j in range(i + 1, min(n, i + longest) + 1):
            kind = words.get(text[i:j])
            if kind is not None:
                c = cost[j] + (CLASS_COST if kind else WORD_COST)
                if c <= cost[i]:
                    cost[i], step[i] = c, j - i
    out, i = [], 0
    while i < n:
        word = text[i : i + step[i]]
        out.append((words.get(word, ""), word))
        i += step[i]
    return out


OPEN, CLOSE = "(（[【〔{“„«「『‚‹", ")）]】〕}”“»」』‘›"
_PARTNER = {"(": ")", "（": "）", "[": "]", "【": "】", "〔": "〕", "{": "}", "“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", "‹": "›", '"': '"'}
_OPENED_BY = {c: [o for o, closing in _PARTNER.items() if c in closing] for c in ")）]】〕}”“»」』›\""}
# Terminators: of full width, which need no blank after them, and others which leave no doubt.
WIDE = "。！？｡།༎"
HARD = "!?؟।॥۔።፧։។៕၊။"
TERMINATORS = ".…" + WIDE + HARD
_ENDS = f"[{re.escape(TERMINATORS)}]+"
_QUOTES = re.compile(r"[\"(（\[【〔{“„«「『‹)）\]】〕}”»」』›]")
_MARK = re.compile(f"{_ENDS}|{_QUOTES.pattern}")
_MARK_OR_BLANK = re.compile(rf"{_MARK.pattern}|[ \t　]+")
_SPACE = re.compile(r"\s*")
_LETTERS = re.compile(r"[^\W_]")
# Scripts in which blanks end a unit.
_BY_BLANKS = re.compile(r"[\u0e00-\u0eff]")
_CJK = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]")
_LIST_NUMBER = re.compile(r"\(?(?:[0-9]{1,3}|[A-Za-z])[.)]?\Z")
_NUMBER = re.compile(r"[0-9]{1,2}\Z")
_BLANKS = re.compile(r"[ \t  - 　]+")
_TRAILING = re.compile(r"[\"”»)）\]】」』’›}]+")


def _ahead(block: str, at: int, words: dict[str, str]) -> list[tuple[str, str]]:
    """The words of the part of a sentence that begins at `at`."""
    return words_in(_PART.match(block, at)[0], words)


def _carries_on(block: str, at: int, words: dict[str, str]) -> bool:
    """Whether the words after a closed quotation carry its sentence on: a joining word, or a name that says it."""
    kinds = [k for k, _ in _ahead(block, at, words)]
    if not kinds or kinds[0] == "joins":
        return bool(kinds)
    return "says" in kinds and kinds[0] != "opens"


def _opens(block: str, at: int, words: dict[str, str]) -> bool:
    return (path := _ahead(block, at, words)) != [] and path[0][0] in ("opens", "person")


def _joins(block: str, at: int, words: dict[str, str]) -> bool:
    return (path := _ahead(block, at, words)) != [] and path[0][0] == "joins"


def _last_before(block: str, at: int) -> str:
    """The last character before `at` that isn't blank; '.' where there is none."""
    while at and block[at - 1].isspace():
        at -= 1
    return block[at - 1] if at else "."


def _is_final(block: str, at: int, words: dict[str, str]) -> bool:
    """Whether the word before `at` is a final particle."""
    line = block.rfind("\n", 0, at) + 1
    return (path := words_in(_PART_BEFORE.search(block, line, at)[0], words)) != [] and path[-1][0] == "final"


def _spans(block: str) -> list[tuple[int, int]]:
    """(opening, end) of the quotations and brackets of a block that are closed in it, outermost only."""
    out: list[tuple[int, int]] = []
    stack: list[tuple[str, int]] = []
    held = Counter()  # openings on the stack, by their character
    for m in _QUOTES.finditer(block):
        ch, at = m[0], m.start()
        if ch == '"' and not held[ch]:
            if at + 1 < len(block) and not block[at + 1].isspace() and (at == 0 or not block[at - 1].isalnum()):
                stack.append((ch, at))
                held[ch] += 1
            continue
        if not any(held[x] for x in _OPENED_BY.get(ch, ())):
            if ch in _PARTNER:
                stack.append((ch, at))
                held[ch] += 1
            continue
        while True:
            opening, start = stack.pop()
            held[opening] -= 1
            if opening in _OPENED_BY[ch]:
                break
        while out and out[-1][0] > start:
            out.pop()
        out.append((start, at + 1))
    return out


def _word_start(block: str, at: int) -> int:
    """Where the run of characters before `at` without blanks and opening marks begins."""
    while at and not block[at - 1].isspace() and block[at - 1] not in OPEN and block[at - 1] != '"':
        at -= 1
    return at


def _previous(block: str, at: int) -> str:
    """The run without blanks that ends before the blanks before `at`."""
    while at and block[at - 1].isspace():
        at -= 1
    end = at
    while at and not block[at - 1].isspace():
        at -= 1
    return block[at:end]


def _starts(block: str, at: int) -> bool:
    """Whether a sentence may start at `at`: an upper-case letter, also after an opening mark, or a caseless letter."""
    while at < len(block) and (block[at] in '¿¡"' or block[at] in OPEN or block[at].isspace()):
        at += 1
    if at >= len(block):
        return False
    if LOWER_NAMES.match(block, at):
        return True
    ch = block[at]
    return ch.isupper() or ch.isalpha() and not ch.islower()


#: Costs of the readings of a gap: for what nothing speaks against, something does, much does, and all does.
FREE, UNLIKELY, BAD, NEVER = 0, 2, 6, 99
_END, _ON = (FREE, NEVER), (NEVER, FREE)  # (the sentence ends, it goes on), where marks alone decide


def _dot(block: str, begin: int, at: int, after: int) -> tuple[int, int, bool]:
    """Costs of a dot at `at` after the word that begins at `begin`, and whether the word makes a pair with the one before.

    The readings that go on are number, initial and abbreviation; of those only the cheapest is kept.
    """
    word = block[begin:at]
    w = word.rstrip(".").lower()
    if not w:
        return FREE, BAD, False
    may_end = (FREE if _starts(block, after) else BAD, UNLIKELY)
    prev = _previous(block, begin)
    before = prev.rstrip(".").lower().lstrip("(„“«\"") if prev.endswith(".") else ""
    if (before, w) in PAIRS or (w == "h" and before == "d"):
        return (*may_end, True) if w != "h" else (BAD, FREE, True)
    if _NUMBER.match(word):
        return (BAD, FREE, False) if MONTHS.match(block, after) or prev.lower() in ORDINAL_AFTER else (FREE, BAD, False)
    if w in MAY_END:
        return (BAD, FREE, False) if COMPANY.match(block, after) else (*may_end, False)
    if w in RUNS_ON:
        return (*may_end, False) if w in WORDS_TOO else (BAD, FREE, False)
    if len(w) == 1 and w.isalpha() and word[0] != w:
        return BAD, FREE, False
    if "." in w and all(len(x) == 1 and x.isalpha() for x in w.split(".")):
        return (*may_end, False) if word[0] == w[0] else (BAD, FREE, False)
    return FREE, BAD, False


class Gap:
    """A place where a sentence may end: a column of the lattice.

    end is where it would end. costs are those of ending and of going on; fresh those which hold instead if a sentence
    begins at `start`, where the word, quotation or bracket before the gap begins. pair: the dot before belongs to
    the same abbreviation, so no sentence ends there.
    """

    __slots__ = ("end", "start", "costs", "fresh", "pair")

    def __init__(self, end: int, costs: tuple[int, int], start: int = -1, fresh: tuple[int, int] | None = None, pair: bool = False):
        self.end, self.costs, self.start, self.fresh, self.pair = end, costs, start, fresh or costs, pair


def gaps(block: str, words: dict[str, str]) -> list[Gap]:
    """The columns of the lattice: every gap after a terminator, or after a quotation or bracket that ends with one,
    outside of all others; and in spaceless scripts blanks between a final particle and an opening word."""
    n, cjk = len(block), _CJK.search(block) is not None
    spans, s, out = _spans(block), 0, []
    for m in (_MARK_OR_BLANK if cjk else _MARK).finditer(block):
        at, e, marks = m.start(), m.end(), m[0]
        if marks[0].isspace():
            if e < n and not (s < len(spans) and spans[s][0] < at < spans[s][1]) and _CJK.match(block[at - 1 : at]) and _CJK.match(block, e):
                if _is_final(block, at, words) and _opens(block, e, words):
                    out.append(Gap(at, (FREE, UNLIKELY)))
            continue
        ends = marks[-1] in TERMINATORS
        while s < len(spans) and spans[s][1] <= at:
            s += 1
        span = spans[s] if s < len(spans) and spans[s][0] <= at else None
        if span is not None:
            if ends or e != span[1]:
                continue
            inner = block[span[0] + 1 : at].rstrip()
            if not inner or inner[-1] not in TERMINATORS:
                continue
            marks = inner[-1]
        elif not ends:
            continue
        elif (t := _TRAILING.match(block, e)) and not (s < len(spans) and spans[s][0] <= e):
            e = t.end()
        after = _SPACE.match(block, e).end()
        if after >= n:
            break
        nx, gap = block[after], after > e
        if nx in ",;:，、；：" or nx in ")]}）】」』”»" and not (nx == "”" and gap):
            continue
        if span is not None and not _LETTERS.search(inner):
            continue  # an aside that holds marks alone
        if "…" in marks or len(marks) > 1 and set(marks) == {"."}:
            if cjk and not gap:
                end = _opens(block, after, words) or _is_final(block, at, words) and not _joins(block, after, words)
            else:
                end = gap and (_starts(block, after) or cjk and _opens(block, after, words))
            out.append(Gap(e, (FREE, UNLIKELY) if end else (BAD, FREE)))
            continue
        if marks[-1] in WIDE or cjk and marks[-1] in "!?" and not gap and _CJK.match(nx):
            on = False
            if span is not None and block[span[0]] not in "（(":
                lead = _last_before(block, span[0])
                on = lead not in "：:" and _carries_on(block, after, words)
            out.append(Gap(e, (BAD, FREE) if on else (FREE, BAD)))
            continue
        if not gap:
            continue
        if nx in "—–-" and block[after + 1 : after + 2].isspace():
            out.append(Gap(e, _ON))
        elif span is None:
            if marks[-1] in HARD:
                out.append(Gap(e, _END))
            else:
                begin = _word_start(block, at)
                end, on, pair = _dot(block, begin, at, after)
                listed = (NEVER, FREE) if _LIST_NUMBER.match(block[begin:at]) else None
                out.append(Gap(e, (end, on), begin, listed, pair))
        else:
            costs = fresh = (BAD, FREE) if nx.islower() and not LOWER_NAMES.match(block, after) else (FREE, BAD)
            if marks[-1] not in HARD:
                if block[span[0]] in "([":
                    fresh = (FREE, BAD)
                dot = len(block[: at].rstrip()) - 1
                if not inner.endswith("..") and _dot(block, max(_word_start(block, dot), span[0] + 1), dot, n)[0] != FREE:
                    costs = (BAD, FREE)
            out.append(Gap(e, costs, span[0], fresh))
    return out


def best_ends(block: str, columns: list[Gap]) -> list[int]:
    """The ends on the cheapest path through the lattice: each column is read as an end or as going on, what a reading
    costs depends on how the column before was read."""
    # of paths that read the last column as an end, or as going on: (cost, link to the ends before)
    end: tuple[int, tuple | None] = (FREE, None)  # a sentence begins with the block
    on: tuple[int, tuple | None] = (NEVER * 10, None)
    last = 0
    for g in columns:
        near = g.start >= last and not block[last : g.start].strip()
        after_end = end[0] + (NEVER if g.pair and last else 0)
        c = g.fresh if near else g.costs
        new_end = min((after_end + c[0], (g.end, end[1])), (on[0] + g.costs[0], (g.end, on[1])), key=_cost)
        new_on = min((after_end + c[1], end[1]), (on[0] + g.costs[1], on[1]), key=_cost)
        end, on, last = new_end, new_on, g.end
    out, link = [], min(end, on, key=_cost)[1]
    while link is not None:
        out.append(link[0])
        link = link[1]
    return out[::-1]


def _cost(path: tuple) -> int:
    return path[0]


def boundaries(block: str, words: dict[str, str] = CLASSES) -> list[int]:
    """The ends of the sentences inside a block of prose, as offsets; the last end is the block's."""
    n = len(block)
    blanks = len(_BY_BLANKS.findall(block))
    if blanks and 2 * blanks > len(_LETTERS.findall(block)) - blanks:
        inside = _spans(block)
        cuts, i = [], 0
        for m in _BLANKS.finditer(block):
            while i < len(inside) and inside[i][1] <= m.start():
                i += 1
            if i == len(inside) or m.start() < inside[i][0]:
                cuts.append(m.start())
        return [*cuts, n]
    return [*best_ends(block, gaps(block, words)), n]


def sentences(text: str | None, words: dict[str, str] = CLASSES) -> list[tuple[int, int]]:
    """(start, end) of the units of the sender's own prose in a mail, without surrounding white space."""
    out = []
    if not text:
        return out
    for a, b in own_blocks(text):
        block, start = text[a:b], 0
        for end in boundaries(block, words):
            unit = block[start:end]
            if _LETTERS.search(unit):
                left = len(unit) - len(unit.lstrip())
                out.append((a + start + left, a + start + len(unit.rstrip())))
            start = end
    return out


def _run(words: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, starts, ends = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                units = sentences(text, words)
                ids += [doc] * len(units)
                starts += [a for a, _ in units]
                ends += [b for _, b in units]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())],
                ["doc_id", "start_char", "end_char"],
            )

    return run


def sentence_units(docs: DataFrame, vocabulary: str = "byte_bpe_multi_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, start_char, end_char): the sentence units of every document's own prose, as code point offsets.

    A narrow map over Arrow batches without any shuffle: a document is read on its own, whatever its language column
    says; scripts are told by their letters. All gaps of a block that may end a sentence are the columns of a lattice,
    with the costs of the readings end, number, list number, initial, abbreviation, ellipsis and quotation; the
    cheapest path decides them together. In scripts without blanks the words around a doubtful gap (after a quotation, an ellipsis, a
    blank) are those of the cheapest path through a word lattice over the dictionary of a public vocabulary, and
    final particles, joining, saying and opening words class the gap. In Thai and Lao blanks end units.
    A NULL or empty text, and one without own prose, have no rows; repeated documents each have theirs; extra columns
    are ignored. The dictionary (a few hundred words) goes along with the tasks.
    """
    words = dictionary(ranks_of(load_ranks(vocabulary, folder)))
    return docs.select("doc_id", "text").mapInArrow(_run(words), "doc_id long, start_char int, end_char int")

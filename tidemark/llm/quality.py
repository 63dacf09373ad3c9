"""Per-document text quality statistics, and text types from noisy thresholds on them.

Every statistic threshold is a labelling function that votes for one type or abstains.
How often each function fires on each type is learned without labels, by expectation
maximisation on the agreements of the votes over all documents, and each document gets
the posterior over prose, list, table and junk.

Only distinct vote patterns leave the executors: at most 2^(number of functions), however
many documents there are.

Defined cases: null, empty and blank texts have null statistics, no votes and no type;
equal posteriors go to the earlier of prose, list, table, junk; repeated rows each give
their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re as plain
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.grouped import spread

KINDS = ["prose", "list", "table", "junk"]

#: Function words of the corpus's languages (fixed values).
COMMON = {
    "en": "the of and to in a is that for it on was as with by be are we at this from has have not but which than more our will or an its they were would could there their been had you i he who so if no all after some one said",
    "de": "der die das und ist in den von zu mit dem des ein eine auf für sich nicht im auch als bei wurde wir es war sind aus nach wird dass um sie noch einer hat",
    "fr": "le la les de des et en un une est que dans pour sur au aux par plus ce qui a été du à l d il ne pas son cette se avec ont",
    "es": "el los las y del se por con para una al su más no es lo que la de en un ha fue como entre sus este esta han",
}
COMMON_WORDS = frozenset(" ".join(COMMON.values()).split())
#: Labels of web page furniture (fixed values).
FURNITURE = frozenset("home menu login log in sign subscribe cookies cookie search rss sitemap share print next previous back top accept all rights reserved investors page contact privacy terms copyright skip close read more click here".split())

BREAK = re.compile(r"[\r\n\v\f\x85\u2028\u2029]+")
WORD = re.compile(r"[\p{L}\p{M}]+")
KANA = re.compile(r"[\p{Hiragana}\p{Katakana}]")
HAN = re.compile(r"[\p{Hiragana}\p{Katakana}\p{Han}]")
MARKER = re.compile(r"\s*(?:[-*+•–—·◦▪‣○●]|\[[ xX]?\]|[☐☑☒✓]|\(?(?:\d{1,3}|[a-zA-Z]|[ivxIVX]{1,5})[.)])\s")
ENDINGS, CLOSING = frozenset(".!?…。！？"), "\"'”’»）)]"
NUMERIC = re.compile(r"[(\"'$€£¥~+\-–−]*\d[\d.,  ]*[%xmMkKbB]?[)\"']*$|[-–—]+$|n/?a$", re.IGNORECASE)
RULE = re.compile(r"\s*[|+:=\-\s]+$")
LEADER = re.compile(r"\.{4,}|(?:\. ){4,}")
GAP = re.compile(r"\t+| {3,}|\xa0{3,}|\||</td>")
HEX = re.compile(r"(?:0x)?[0-9a-f]{2}$|[0-9a-f]{8}:?$", re.IGNORECASE)
BROKEN = re.compile(r"[ÃÂâ][\x80-\xbf€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ¡-¿]|ï¿½|�")
ODD = re.compile(r"[^\p{L}\p{M}\p{N}\s.,;:!?'\"()\-–—%$€£¥&/’‘“”«»…·•。、！？（）「」・･ー％＄]")
INSIDE = re.compile(r"[\p{Latin}\d][^\p{L}\p{M}\p{N}\s'’.,\-–—/&:%€$£¥()、。]+[\p{Latin}\d]|[¬°^~|`_#{}\\=*<>@]\p{Latin}|\p{Latin}[¬°^~|`_#{}\\=*<>@!]")
LABEL = re.compile(r"[\p{Lu}\d]")
BREAKS = plain.compile("[ÃÂâï�]")
RARE = plain.compile(" [/·|>•–] ")
INLINE = re.compile(r", | / | · | \| | > |; | • | – ")

STATS = ["words", "word_length", "symbol_ratio", "ending_share", "common_share", "lines", "words_per_line", "prose_share", "list_share", "table_share", "short_share", "number_share", "furniture_share", "broken_share", "inside_share", "hex_share", "odd_share", "longest_word", "distinct_share", "item_length", "items", "label_share"]


EDGE = ".,;:!?…\"'”’“‘«»()[]。、"


def gap_cells(line: str) -> list[str]:
    return [c for c in GAP.split(line) if c.strip()]


def csv_cells(line: str) -> list[str]:
    """Cells between commas outside double quotes; an unpaired quote is an ordinary character."""
    if line.count('"') % 2:
        return line.split(",")
    cells, open_ = [], ""
    for i, part in enumerate(line.split('"')):
        if i % 2:
            open_ += part
            continue
        first, *rest = part.split(",")
        open_ += first
        for cell in rest:
            cells.append(open_)
            open_ = cell
    return [*cells, open_]


def numeric(cell: str) -> bool:
    return bool(NUMERIC.match(cell.strip()))


class TokenFacts:
    """What the statistics need to know of each token, with ``common`` as function words. Keeps the facts of at most ``most`` tokens of at most 40 characters, which only saves work."""

    def __init__(self, common: Iterable[str], most: int = 200_000):
        self.common, self.most, self.kept = frozenset(common), most, {}

    def of(self, tokens: list[str]) -> list[tuple]:
        known = self.kept.get
        return [known(t) or self.fresh(t) for t in tokens]

    def fresh(self, token: str) -> tuple:
        """Whether a token is numeric, a byte of a dump, has symbols inside, is a function word; its characters, words,
        characters in words, furniture words, odd characters, digits, East Asian characters and kana; the words."""
        words = WORD.findall(token.lower())
        plain = token.isascii()
        found = (
            numeric(token), bool(HEX.match(token)), bool(INSIDE.search(token)), token.lower().strip(EDGE) in self.common, len(token), len(words), sum(map(len, words)), sum(w in FURNITURE for w in words),
            len(ODD.findall(token)), sum(map(str.isdigit, token)), 0 if plain else len(HAN.findall(token)), 0 if plain else len(KANA.findall(token)), words,
        )
        if len(token) <= 40:
            if len(self.kept) >= self.most:
                self.kept.clear()
            self.kept[token] = found
        return found


class Line:
    """A line that is not blank, cut into tokens once for all statistics; the sums of its tokens' facts."""

    __slots__ = ("text", "tokens", "facts", "words", "sums")

    def __init__(self, text: str, facts: TokenFacts):
        self.text = text
        self.tokens = text.split()
        self.facts = facts.of(self.tokens)
        *counts, self.words = zip(*self.facts)
        self.sums = list(map(sum, counts))

    def kind(self) -> str:
        """prose, list, table, short (a few words) or other."""
        line, body = self.text, self.text.strip()
        _, dump, _, known, solid, words, _, furniture, _, _, han, kana = self.sums
        if words and (furniture * 2 >= words or dump * 2 > len(self.tokens)):
            return "other"
        spoken = words >= 5 and known >= 0.2 * words and len(set(chain.from_iterable(self.words))) >= 4
        if not spoken and han:
            spoken = han >= 8 and han > 0.4 * len(body) and kana >= 0.2 * han
        marked = bool(MARKER.match(line))
        if spoken and not (marked and words < 8) and line.count("|") < 3 and "<td" not in line:
            return "prose"
        if "<td" in line or "<th" in line or (RULE.match(line) and ("|" in line or "+" in line)):
            return "table"
        if "...." in body or ". . . . " in body:
            after = LEADER.split(body)[-1].split()
            if after and numeric(after[0]):
                return "table"
        commas = csv_cells(body) if "," in body else [body]
        gaps = gap_cells(body)
        for cells in (gaps, commas):
            if len(cells) >= 3 and sum(numeric(c) for c in cells[1:]) * 2 >= len(cells) - 1:
                return "table"
            if len(cells) == 2 and numeric(cells[1]) and not numeric(cells[0]):
                return "table"
        if (body[:1] == "|" and body[-1:] == "|" and len(body) > 1) or (body.startswith(",") and len(commas) >= 3):
            return "table"
        if marked:
            return "list"
        if len(gaps) >= 3 and all(len(c) <= 8 for c in gaps):
            return "table"
        return "short" if len(self.tokens) <= 9 and len(body) <= 90 else "other"

    def ended(self) -> bool:
        """Whether the line ends in punctuation, with closing quotes and brackets after it or not."""
        return self.text.rstrip().rstrip(CLOSING)[-1:] in ENDINGS


def inline_items(text: str) -> list[str]:
    """The parts between separators; a text with the two usual ones only is cut without a pattern."""
    parts = text.replace("; ", ", ").split(", ") if not RARE.search(text) else INLINE.split(text)
    return [x for x in parts if x.strip()]


def statistics(text: str, facts: TokenFacts | None = None) -> list[float]:
    """The STATS of a text that is not blank."""
    facts = facts or TokenFacts(COMMON_WORDS)
    lines = [Line(x, facts) for x in BREAK.split(text) if x.strip()]
    tokens = [t for x in lines for t in x.tokens]
    total = len(tokens)
    number, dump, inside, common, solid, words, letters, furniture, odd, digits, han, kana = map(sum, zip(*(x.sums for x in lines)))
    number, dump, inside, common = number / total, dump / total, inside / total, common / total
    furniture = furniture / words if words else 0.0
    spoken = min(1.0, common * total / words) if words and furniture < 0.5 and dump < 0.6 else 0.0
    if han > 0.3 * solid:
        spoken = max(spoken, min(1.0, kana / han))
    weight = {"prose": 0, "list": 0, "table": 0, "short": 0, "other": 0}
    for x in lines:
        weight[x.kind()] += len(x.text.strip())
    all_chars = sum(weight.values())
    items = inline_items(" ".join(tokens))
    tall = tokens if not han else [t for x in lines for t, f in zip(x.tokens, x.facts) if f[10] * 2 < f[4]]
    sizes = [x.count(" ") + 1 if x[0] != " " and x[-1] != " " else len(x.split()) for x in items]
    broken = BROKEN.findall(text) if BREAKS.search(text) else []
    return [
        float(total),
        solid / total,
        1 - (letters + digits) / solid,
        sum(x.ended() for x in lines) / len(lines),
        spoken,
        float(len(lines)),
        total / len(lines),
        weight["prose"] / all_chars,
        weight["list"] / all_chars,
        weight["table"] / all_chars,
        weight["short"] / all_chars,
        number,
        furniture,
        sum(map(len, broken)) / solid,
        inside,
        dump,
        odd / solid,
        float(max(map(len, tall), default=0)),
        len(set(tokens)) / total,
        sum(sizes) / max(1, len(sizes)),
        float(len(items)),
        sum(n <= 6 and bool(LABEL.match(x.strip())) for n, x in zip(sizes, items)) / max(1, len(items)),
    ]


#: name, type voted for, condition on the statistics (a dict of arrays)
FUNCTIONS = [
    ("common_words", "prose", lambda s: s["common_share"] >= 0.25),
    ("prose_lines", "prose", lambda s: s["prose_share"] >= 0.5),
    ("sentences", "prose", lambda s: (s["ending_share"] >= 0.5) & (s["words_per_line"] >= 6) & (s["common_share"] >= 0.15)),
    ("long_lines", "prose", lambda s: (s["words_per_line"] >= 9) & (s["common_share"] >= 0.2) & (s["inside_share"] < 0.2)),
    ("marked_lines", "list", lambda s: s["list_share"] >= 0.4),
    ("item_lines", "list", lambda s: (s["lines"] >= 2) & (s["list_share"] + s["short_share"] >= 0.6) & (s["common_share"] < 0.2) & (s["furniture_share"] < 0.3) & (s["distinct_share"] > 0.1)),
    ("short_lines", "list", lambda s: (s["lines"] >= 3) & (s["words_per_line"] <= 7) & (s["common_share"] < 0.2) & (s["number_share"] < 0.3) & (s["table_share"] < 0.3) & (s["distinct_share"] > 0.1)),
    ("inline_items", "list", lambda s: (s["items"] >= 4) & (s["item_length"] <= 5) & (s["common_share"] < 0.15) & (s["furniture_share"] < 0.3) & (s["table_share"] < 0.3) & (s["distinct_share"] > 0.1) & (s["longest_word"] < 40)),
    ("labels", "list", lambda s: (s["items"] >= 4) & (s["label_share"] >= 0.5) & (s["furniture_share"] < 0.3) & (s["common_share"] < 0.2) & (s["table_share"] < 0.3)),
    ("table_lines", "table", lambda s: s["table_share"] >= 0.5),
    ("numbers", "table", lambda s: (s["number_share"] >= 0.3) & (s["hex_share"] < 0.5) & (s["common_share"] < 0.2)),
    ("table_rows", "table", lambda s: (s["table_share"] >= 0.3) & (s["prose_share"] < 0.4) & (s["lines"] >= 2)),
    ("broken_text", "junk", lambda s: s["broken_share"] >= 0.05),
    ("odd_symbols", "junk", lambda s: (s["odd_share"] >= 0.12) & (s["table_share"] < 0.3) & (s["list_share"] < 0.4)),
    ("long_words", "junk", lambda s: (s["longest_word"] >= 50) & (s["common_share"] < 0.15) & (s["table_share"] < 0.3)),
    ("unknown_words", "junk", lambda s: (s["common_share"] < 0.12) & (s["words_per_line"] >= 9) & (s["table_share"] < 0.3) & (s["number_share"] < 0.2) & ((s["item_length"] > 5) | (s["items"] < 4))),
    ("furniture", "junk", lambda s: s["furniture_share"] >= 0.5),
    ("mixed_words", "junk", lambda s: (s["inside_share"] >= 0.25) & (s["table_share"] < 0.3) & (s["list_share"] < 0.4)),
    ("dump", "junk", lambda s: s["hex_share"] >= 0.6),
    ("repetition", "junk", lambda s: (s["distinct_share"] <= 0.15) & (s["words"] >= 8) & (s["common_share"] < 0.2) & (s["table_share"] < 0.5) | (s["distinct_share"] * s["words"] <= 5) & (s["words"] >= 8) & (s["prose_share"] < 0.5) | (s["words"] <= 3) & (s["longest_word"] >= 40)),
]


def votes_of(stats: np.ndarray) -> np.ndarray:
    """Bit mask of the functions that fire, for each row of statistics."""
    s = dict(zip(STATS, stats.T))
    mask = np.zeros(len(stats), dtype="int64")
    for i, (_, _, rule) in enumerate(FUNCTIONS):
        mask |= np.asarray(rule(s)).astype("int64") << i
    return mask


def measure(common: Iterable[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        facts = TokenFacts(common)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            real = [i for i, t in enumerate(texts) if t is not None and t.strip()]
            stats = np.full((len(texts), len(STATS)), np.nan)
            mask = np.full(len(texts), -1, dtype="int64")
            if real:
                stats[real] = [statistics(texts[i], facts) for i in real]
                mask[real] = votes_of(stats[real])
            columns = [pa.array(column, mask=np.isnan(column)) for column in stats.T]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(mask, mask=mask < 0)], names=[batch.schema.names[0], *STATS, "votes"])

    return run


def text_statistics(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", common: dict[str, str] | None = None) -> DataFrame:
    """doc_id, the STATS and the votes (bit mask) of every document.

    ``common``: function words per language, blank-separated (COMMON unless given). Prose of a language that is neither
    in it nor written with kana is not known as prose, so a corpus in other languages wants their lists here.
    """
    kind = dict(documents.dtypes)[doc_id]
    schema = ", ".join([f"`{doc_id}` {kind}", *(f"{s} double" for s in STATS), "votes long"])
    words = COMMON_WORDS if common is None else frozenset(" ".join(common.values()).split())
    return spread(documents.select(doc_id, text)).mapInArrow(measure(words), schema)


def learn_types(patterns: np.ndarray, counts: np.ndarray, rounds: int = 10_000, strength: float = 20.0) -> np.ndarray:
    """Posterior over KINDS of each vote pattern, by expectation maximisation.

    Each function has two unknowns: how often it fires on its own type, and how often on
    any other. The start is a guess (0.7 and 0.03), which also acts as ``strength`` prior
    observations. It goes on until no posterior moves by more than 1e-6; ``rounds`` only guards, and raises.
    """
    fires = (patterns[:, None] >> np.arange(len(FUNCTIONS))) & 1
    target = np.array([KINDS.index(kind) for _, kind, _ in FUNCTIONS])
    own = target[:, None] == np.arange(len(KINDS))
    rate, share = np.where(own, 0.7, 0.03), np.full(len(KINDS), 1 / len(KINDS))
    posterior = np.zeros((len(patterns), len(KINDS)))
    for _ in range(rounds):
        log = np.log(share) + fires @ np.log(rate) + (1 - fires) @ np.log1p(-rate)
        log -= log.max(axis=1, keepdims=True)
        fresh = np.exp(log)
        fresh /= fresh.sum(axis=1, keepdims=True)
        if np.abs(fresh - posterior).max(initial=0) < 1e-6:
            break
        posterior = fresh
        weight = posterior * counts[:, None]
        total = weight.sum(axis=0)
        fired = fires.T @ weight
        hit = ((fired * own).sum(axis=1) + 0.7 * strength) / ((total * own).sum(axis=1) + strength)
        miss = ((fired * ~own).sum(axis=1) + 0.03 * strength) / ((total * ~own).sum(axis=1) + strength)
        rate = np.where(own, hit[:, None], miss[:, None])
        share = (total + 1) / (total.sum() + len(KINDS))
    else:
        raise ArithmeticError(f"types not settled after {rounds} rounds")
    return posterior


def text_types(measured: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """doc_id, kind and the posterior of each type, of every document that has votes."""
    spark = measured.sparkSession
    seen = measured.where("votes is not null").groupBy("votes").count().collect()  # at most 2^20 patterns by construction, in practice some hundred
    patterns, counts = np.array([r["votes"] for r in seen], dtype="int64"), np.array([r["count"] for r in seen], dtype=float)
    posterior = learn_types(patterns, counts)
    best = [KINDS[i] for i in posterior.argmax(axis=1)] if len(seen) else []
    rows = [(int(p), k, *map(float, q)) for p, k, q in zip(patterns, best, posterior)]
    table = spark.createDataFrame(rows, "votes long, kind string, " + ", ".join(f"p_{k} double" for k in KINDS))
    return measured.select(doc_id, "votes").join(F.broadcast(table), "votes").drop("votes")

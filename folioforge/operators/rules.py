"""Rewrite rules as data.

A :class:`Rule` is one ordered rewrite.  The shipped lists are the house defaults;
every operator takes any list of rules, so users bring their own.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import WORD_CHAR, bounded, quote_replacement


@dataclass(frozen=True)
class Rule:
    """One rewrite.

    ``phrase``      whole word(s) to look for; or, with ``regex=True``, a Java regex.
    ``replacement`` literal text (for ``regex=True`` group references are allowed).
    ``upper``       result when the match starts with an upper-case letter; the plain
                    ``replacement`` is then used for lower-case matches only.
    ``hint``        for ``regex=True``: a cheaper pattern that every match contains.
    """

    phrase: str
    replacement: str
    label: str
    ignore_case: bool = True
    upper: str | None = None
    regex: bool = False
    family: str = "custom"
    hint: str | None = None

    def __post_init__(self) -> None:
        if self.upper is not None and (self.regex or not self.ignore_case):
            raise ValueError("case-preserving rules are plain, case-insensitive phrases")
        if self.upper is not None and re.search(
            rf"(?i)(?<!{WORD_CHAR}){re.escape(self.phrase)}(?!{WORD_CHAR})", self.upper
        ):
            raise ValueError("the upper-case result must not contain the phrase itself")

    @property
    def pattern(self) -> str:
        return self.phrase if self.regex else bounded(self.phrase, self.ignore_case)

    def steps(self) -> list[tuple[str, str]]:
        """(pattern, replacement) pairs whose sequence performs the rule."""
        if self.upper is None:
            rep = self.replacement if self.regex else quote_replacement(self.replacement)
            return [(self.pattern, rep)]
        first, rest = self.phrase[0], re.escape(self.phrase[1:]).replace("\\ ", " ")
        pairs = []
        for head, result in ((first.upper(), self.upper), (first.lower(), self.replacement)):
            body = f"{head}(?i:{rest})"
            pattern = f"{body}(?!{WORD_CHAR})(?<!{WORD_CHAR}{body})"
            pairs.append((pattern, quote_replacement(result)))
        return pairs


@dataclass(frozen=True)
class FunctionRule:
    """One rewrite whose result is a Python function of the match; ``pattern`` is a Python
    regex. It keeps its place among the other rules and its row in the audit, but runs in
    Arrow batches instead of the JVM, so it is for what a :class:`Rule` cannot say."""

    pattern: str
    replace: Callable[[str], str]
    label: str
    family: str = "custom"


def _rules(family: str, rows: list[tuple], **common) -> list[Rule]:
    out = []
    for phrase, replacement, label, *upper in rows:
        up = upper[0] if upper else None
        out.append(Rule(phrase, replacement, label, upper=up, family=family, **common))
    return out


# --- Fixed values: the default house rules, in the order they are applied. -------------
# (phrase, result, label[, result when the match starts upper-case])

_TERM = "terminology"
_EXACT = {"ignore_case": False}

TERMINOLOGY_RULES: list[Rule] = [
    *_rules(
        _TERM,
        [
            ("saints", "swamis", "saint(s)→Swami(s)", "Swamis"),
            ("saint", "swami", "saint→Swami", "Swami"),
            ("monks", "swamis", "monk(s)→Swami(s)", "Swamis"),
            ("monk", "swami", "monk→Swami", "Swami"),
            ("temples", "mandirs", "temple(s)→mandir(s)", "Mandirs"),
            ("temple", "mandir", "temple→mandir", "Mandir"),
            ("haribhaktas", "devotees", "haribhakta(s)→devotee(s)"),
            ("haribhakta", "devotee", "haribhakta→devotee"),
            ("followers", "devotees", "follower(s)→devotee(s)", "Devotees"),
            ("follower", "devotee", "follower→devotee", "Devotee"),
            ("penance", "austerities", "penance→austerities"),
            ("torchbearer", "successor", "torchbearer→successor"),
            ("aarti", "arti", "aarti→arti"),
            ("vicharan", "vichran", "vicharan→vichran"),
            ("dhotiyos", "dhotiyas", "dhotiyos→dhotiyas"),
            ("Brahmic state", "brahmisthiti", "Brahmic state→brahmisthiti"),
            ("scriptures", "shastras", "scripture(s)→shastra(s)", "Shastras"),
            ("scripture", "shastra", "scripture→shastra", "Shastra"),
            ("congregation", "satsang", "congregation→satsang"),
            ("Hindu mythology", "Hindu sacred history", "Hindu mythology→Hindu sacred history"),
            ("mythology", "sacred history", "mythology→sacred history"),
        ],
    ),
    *_rules(
        _TERM,
        [
            (
                "Lord Swaminarayan",
                "Bhagwan Swaminarayan",
                "Lord Swaminarayan→Bhagwan Swaminarayan",
            )
        ],
        **_EXACT,
    ),
    *_rules(_TERM, [("divine abode", "Akshardham", "divine abode→Akshardham")]),
    *_rules(
        _TERM,
        [
            ("Shrijimaharaj", "Shriji Maharaj", "Shrijimaharaj→Shriji Maharaj"),
            ("Shri Ji Maharaj", "Shriji Maharaj", "Shri Ji Maharaj→Shriji Maharaj"),
        ],
        **_EXACT,
    ),
    *_rules(
        _TERM,
        [
            ("sadhus", "swamis", "sadhu(s)→Swami(s)", "Swamis"),
            ("sadhu", "swami", "sadhu→Swami", "Swami"),
            ("sannyasis", "bawas", "sannyasis→bawas"),
            ("sannyasi", "bawa", "sannyasi→bawa"),
            ("avatari personage", "avatari Purush", "avatari personage→avatari Purush"),
        ],
    ),
    *_rules(
        _TERM,
        [("avataric Purush", "avatari Purush", "avataric Purush→avatari Purush")],
        **_EXACT,
    ),
    *_rules(
        _TERM,
        [
            ("fellowship", "satsang", "fellowship→satsang"),
            ("recitation", "mukhpath", "recitation→mukhpath"),
        ],
    ),
]

PERSONAL_NAME_RULES: list[Rule] = _rules(
    "personal_name",
    [
        ("Bhilalbhai", "Bhailalbhai", "Bhilalbhai→Bhailalbhai"),
        ("Narayanda", "Naran’da", "Narayanda→Naran’da"),
        ("Naranda", "Naran’da", "Naranda→Naran’da"),
    ],
    **_EXACT,
)

PLACE_NAME_RULES: list[Rule] = _rules(
    "place_name",
    [
        ("Pipalana", "Piplana", "Pipalana→Piplana"),
        ("Chanasad", "Chansad", "Chanasad→Chansad"),
        ("Bamangaon", "Bamangam", "Bamangaon→Bamangam"),
        ("Dholiya", "Dhuliya", "Dholiya→Dhuliya"),
        ("Dungara", "Dangara", "Dungara→Dangara"),
        ("Bhadarod", "Bhadrod", "Bhadarod→Bhadrod"),
        ("Chokshi", "Choksi", "Chokshi→Choksi"),
        ("Mumbai Province", "Bombay Province", "Mumbai Province→Bombay Province"),
        ("Saurashtra", "Kathiawad", "Saurashtra→Kathiawad"),
    ],
    **_EXACT,
)

FORBIDDEN_VOCAB_RULES: list[Rule] = _rules(
    "forbidden_vocab",
    [
        ("legendary", "renowned", "forbidden: legendary→renowned"),
        ("charismatic", "inspiring", "forbidden: charismatic→inspiring"),
        ("revolutionary", "transformative", "forbidden: revolutionary→transformative"),
        ("revolutionised", "transformed", "forbidden: revolutionised→transformed"),
        ("progressive", "devoted", "forbidden: progressive→devoted"),
        ("humanitarian", "compassionate", "forbidden: humanitarian→compassionate"),
        ("empowerment", "spiritual strength", "forbidden: empowerment→spiritual strength"),
        ("stakeholder", "devotee", "forbidden: stakeholder→devotee"),
        ("role model", "ideal", "forbidden: role model→ideal"),
        ("milestone", "occasion", "forbidden: milestone→occasion"),
        ("life-changing", "spiritually transformative", "forbidden: life-changing"),
    ],
)

HEDGING_RULES: list[Rule] = [
    *_rules(
        "hedging",
        [
            ("It seems that", "", 'hedging removed: "It seems that"'),
            ("it seems", "", 'hedging removed: "it seems"'),
            ("It is believed that", "", 'hedging removed: "It is believed that"'),
            ("it is said that", "", 'hedging removed: "it is said that"'),
        ],
    ),
    *_rules(
        "hedging",
        [
            ("Perhaps", "", 'hedging removed: "Perhaps"'),
            ("perhaps", "", 'hedging removed: "perhaps"'),
        ],
        **_EXACT,
    ),
    *_rules("hedging", [("probably", "", 'hedging removed: "probably"')]),
]

_MONTHS = (
    "January|February|March|April|May|June|July|August|September|October|November|December"
)

DATE_RULES: list[Rule] = [
    Rule(
        phrase=f"(?<!{WORD_CHAR})({_MONTHS})\\s+([0-9]{{1,2}}),\\s*([0-9]{{4}})(?!{WORD_CHAR})",
        replacement="$2 $1 $3",
        label="American date→British date format",
        ignore_case=False,
        regex=True,
        family="date_format",
        hint="[0-9],\\s*[0-9]{4}",
    )
]

# Diacritics that are written without their mark (a-macron is allowed).
DIACRITIC_LABEL = "forbidden diacritics stripped (only ā permitted)"
DIACRITIC_MAP: list[tuple[str, str]] = [
    ("ṁ", "m"),
    ("ṭ", "t"),
    ("ṣ", "sh"),
    ("ś", "sh"),
    ("ṇ", "n"),
    ("ī", "i"),
    ("ū", "u"),
    ("ṛ", "r"),
    ("ṅ", "n"),
    ("ḍ", "d"),
    ("ħ", "h"),
    ("ñ", "n"),
]
EXTENDED_DIACRITIC_MAP: list[tuple[str, str]] = [
    ("ī", "i"),
    ("Ī", "I"),
    ("ū", "u"),
    ("Ū", "U"),
    ("ṛ", "ri"),
    ("Ṛ", "Ri"),
    ("ṅ", "n"),
    ("Ṅ", "N"),
    ("ñ", "n"),
    ("Ñ", "N"),
    ("ṭ", "t"),
    ("Ṭ", "T"),
    ("ḍ", "d"),
    ("Ḍ", "D"),
    ("ṇ", "n"),
    ("Ṇ", "N"),
    ("ś", "sh"),
    ("Ś", "Sh"),
    ("ṣ", "sh"),
    ("Ṣ", "Sh"),
    ("ḥ", "h"),
    ("Ḥ", "H"),
]

# Advisory vocabulary that is reported, not rewritten.
FORBIDDEN_VOCABULARY: list[str] = [
    "mythology", "legendary", "charismatic", "revolutionary", "revolutionised",
    "progressive", "humanitarian", "empowerment", "campaign", "grassroots",
    "stakeholder", "role model", "personal philosophy", "compromise", "flexible",
    "trauma", "stress", "anxiety", "closure", "coping", "reform movement", "probably",
    "perhaps", "it seems", "indeed", "truly", "remarkably", "clearly", "undoubtedly",
    "milestone", "legacy", "network", "benchmark", "innovation", "productivity",
    "work ethic", "leadership style", "decision-making skills", "crisis management",
    "strategic vision", "vision statement", "influencer", "charter", "public image",
    "experimental", "organisational growth", "support base", "negotiated",
    "mental strength", "story",
]

# Terms that have to survive every rewrite.
PROTECTED_TERMS: list[str] = [
    "mandir", "seva", "satsang", "arti", "vichran", "mukhpath", "katha", "kirtan",
    "dharma", "moksha", "bhakti", "atma", "maya", "paramhansa", "brahmisthiti",
    "santmandal", "shastra", "Swamishri", "Akshardham", "vachanamrut",
]


@dataclass(frozen=True)
class RuleBook:
    """Rules of one enforcement run: wording first, then dates, then diacritics."""

    wording: tuple[Rule | FunctionRule, ...] = ()
    dates: tuple[Rule, ...] = ()
    diacritics: tuple[tuple[str, str], ...] = tuple(DIACRITIC_MAP)

    @staticmethod
    def default() -> RuleBook:
        return RuleBook(
            wording=(
                *TERMINOLOGY_RULES,
                *PERSONAL_NAME_RULES,
                *PLACE_NAME_RULES,
                *FORBIDDEN_VOCAB_RULES,
                *HEDGING_RULES,
            ),
            dates=tuple(DATE_RULES),
        )

    @staticmethod
    def of(*rules: Rule | FunctionRule) -> RuleBook:
        return RuleBook(wording=tuple(rules))


def rules_table(spark: SparkSession, book: RuleBook) -> DataFrame:
    """The rule book as a table (family, seq, pattern, replacement, case mode, label)."""
    rows = []
    for seq, rule in enumerate((*book.wording, *book.dates)):
        if isinstance(rule, FunctionRule):
            raise ValueError(f"a function cannot be kept in a table: {rule.label}")
        mode = "preserve" if rule.upper is not None else "ignore" if rule.ignore_case else "exact"
        rows.append((rule.family, seq, rule.phrase, rule.replacement, mode, rule.label))
    return spark.createDataFrame(
        rows,
        "family string, seq int, pattern string, replacement string, case_mode string, label string",
    )


def rules_from_table(df: DataFrame, limit: int = 10_000) -> RuleBook:
    """Load user rules from a table shaped like :func:`rules_table`.

    Rules become part of the query plan, so the table must be a small reference table;
    its size is checked before it is read to the driver.
    """
    rows = df.orderBy("seq").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a rule book holds at most {limit} rules")
    wording, dates = [], []
    for r in rows:
        preserve = r.case_mode == "preserve"
        rule = Rule(
            phrase=r.pattern,
            replacement=r.replacement,
            label=r.label,
            ignore_case=r.case_mode != "exact",
            upper=(r.replacement[:1].upper() + r.replacement[1:]) if preserve else None,
            regex=r.family == "date_format",
            family=r.family,
        )
        (dates if r.family == "date_format" else wording).append(rule)
    return RuleBook(wording=tuple(wording), dates=tuple(dates))

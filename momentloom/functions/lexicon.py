"""Word lists, patterns and weights used by the lexical rules.

Everything here is a parameter: operators take a ``Lexicon`` and default to
``DEFAULT``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# These lists, patterns and weights define the results and must
# not change.
ABBREVIATIONS = (
    "mr", "mrs", "ms", "dr", "prof", "sr", "jr", "st", "vs", "etc", "e.g", "i.e",
    "inc", "ltd", "co", "corp", "u.s", "u.k", "a.m", "p.m", "no", "vol", "fig",
)
FILLER = (
    r"\b(um+|uh+|erm+|hmm+|like|you know|i mean|sort of|kind of|basically|"
    r"literally|actually|so yeah|right\?)\b"
)
LEADING_FILLER = r"^\s*(so|and|but|um+|uh+|like|okay|ok|well|yeah|right|anyway|now)\b[\s,]*"
TRAILING_CONNECTIVE = r"\b(and|or|but|because|so|the|a|an|to|of|with|that|which)"
NUMBER = (
    r"\b(\d[\d,\.]*)\s?(%|percent|x|times|years?|months?|days?|"
    r"hours?|minutes?|dollars?|k|million|billion|thousand)?\b"
)
QUESTION = (
    r"\b(why|how|what|when|where|who|which|would you|did you|"
    r"have you|are you|is it|can you)\b"
)
CONTRAST = (
    r"\b(but|however|although|though|instead|whereas|"
    r"on the other hand|turns out|in reality|actually)\b"
)
EMOTION_WORDS = (
    "love", "hate", "fear", "afraid", "scared", "amazing", "incredible",
    "terrible", "awful", "shocked", "surprised", "unbelievable", "insane",
    "crazy", "painful", "heartbreaking", "proud", "ashamed", "excited",
    "furious", "devastated", "thrilled", "grateful", "regret", "worst", "best",
)
STRONG_CLAIM = (
    r"\b(never|always|nobody|no one|"
    r"every(?:one|body) (?:knows|thinks|says|believes|wants|does|has|is)|"
    r"the (biggest|worst|best|only)|"
    r"the truth is|the reality is|the secret|here's the thing|the key|"
    r"most people (don't|think)|the mistake|what nobody tells you|"
    r"i guarantee|the number one)\b"
)
STORY = (
    r"\b(i (was|had|made|went|remember|realised|realized|learned|learnt|started|"
    r"decided|failed|quit|lost|found|built|tried)|when i|back (then|in)|one day|"
    r"a few years ago|the first time|it happened|here's what happened)\b"
)
ACTIONABLE = (
    r"\b(you should|you need to|you have to|the trick is|do this|try this|"
    r"start by|make sure|the way to|step one|first,|here's how|my advice)\b"
)
STOPWORDS = tuple("""
a an the and or but if then else of to in on at by for with without from as is are was were
be been being it its this that these those i you he she they we me him her them us my your our
their his so not no yes do does did done have has had can could would should will shall may might
just really very much more most some any all one two three what when where who why how which than
about into over under out up down off again here there
""".split())
FLAGS = ("question", "number", "contrast", "emotion", "strong_claim", "story", "actionable")
WEIGHTS = {
    "question": 1.4, "number": 1.6, "contrast": 1.5, "emotion": 1.7,
    "strong_claim": 2.2, "story": 2.0, "actionable": 1.8,
}
NOVEL_PHRASES = (
    "nobody tells you", "most people", "the truth", "counterintuitive",
    "surprising", "i was wrong", "turns out", "the secret",
)
STORY_PHRASES = (
    "i learned", "the biggest mistake", "here's what happened",
    "i wish i knew", "when i started", "a few years ago",
)
DANGLING_OPENERS = ("and ", "so ", "but ", "because ", "which ", "that ")
BARE_PRONOUNS = ("it", "they", "he", "she", "this", "that", "these", "those")
CATEGORY_SLUGS = {
    "story": "story", "lesson": "lesson", "insight": "insight",
    "surprising insight": "insight", "advice": "advice", "opinion": "opinion",
    "question": "question", "statistic": "stat", "emotional": "moment",
    "contrarian": "hot-take", "how-to": "how-to", "definition": "explainer",
}
TARGETS_MS = (15_000, 20_000, 30_000, 45_000, 60_000)
# End of fixed values.


@dataclass(frozen=True)
class Lexicon:
    question: str = QUESTION
    number: str = NUMBER
    contrast: str = CONTRAST
    emotion_words: tuple[str, ...] = EMOTION_WORDS
    strong_claim: str = STRONG_CLAIM
    story: str = STORY
    actionable: str = ACTIONABLE
    filler: str = FILLER
    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))


DEFAULT = Lexicon()

"""Broken prompt and response pairs (problem 7).

Method: noisy labelling functions vote on each defect of a pair; a label model per defect (two classes,
votes independent given the class) is fitted by expectation-maximization on the counts of vote
patterns, a bounded table; a defect whose posterior exceeds its cutoff is kept, so a pair may have
several. Priors on the functions (of ``STRENGTH`` rows per row of data) say which of the two classes is "defective".

Two functions are models fitted here on whole tables: the language of a text, from all documents that state one, and
refusals, from all responses, labelled by the sentences of ``REFUSALS``. Cutoffs are validated on defects planted into every
sound pair (one without votes): each is the one of best F1 of the planted pairs against the sound ones. The votes on a planted
pair are worked out where the pair is, and only counts of vote patterns meet. An answer in another language is planted as
the mean over all texts in another one: prompts and texts count by what the votes ask of them, and every kind of prompt
meets every kind of text. A document that serves as such a text is judged by a model of the other half of the documents.

Defined cases: a null response is empty; a null prompt can neither be copied nor set a language; flags
that are null say nothing; a sample delivered again counts as its latest row; a sample without turns
has no finish reason; texts are read whole, of any length; a response delivered twice counts twice in the model of refusals;
without labelled documents or without enough refusals the function that needs them abstains.
"""

from __future__ import annotations

import re
import sys
import unicodedata
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.gram_models import GramModel, counted
from millrace.runtime import bounded_rows, cut

DEFECTS = ("empty", "refusal", "copy", "wrong_language", "truncated")
#: For each defect its functions as (name, P(vote | defective), P(vote | sound)) before any data; ``STRENGTH`` is the
#: weight of these priors in rows per row of data.
FUNCTIONS = {
    "empty": (("blank", 0.5, 1e-4), ("only_markup", 0.6, 1e-4), ("only_thinking", 0.3, 1e-4)),
    "refusal": (("refusing_sentence", 0.9, 0.02), ("nothing_else", 0.9, 0.04), ("refusal_model", 0.8, 0.02)),
    "copy": (("equal_text", 0.6, 1e-4), ("nothing_besides", 0.8, 1e-4), ("part_of_prompt", 0.6, 1e-4)),
    "wrong_language": (("other_language", 0.8, 2e-3), ("none_of_expected", 0.8, 5e-3), ("language_model", 0.9, 5e-3)),
    "truncated": (("status", 0.4, 1e-4), ("flag", 0.4, 1e-4), ("finish_reason", 0.5, 1e-4), ("text_ends_early", 0.6, 1e-3)),
}
PRIOR = 0.03
STRENGTH = 1.0
#: Characters beyond which a text can serve as an answer in another language, and parts of the documents.
LEAST_CHARS, FOLDS = 60, 2
#: Log-odds a run of characters, and letters, from which the models' answer counts; refusals needed for a model of them.
SURE_MARGIN, SURE_LETTERS, LEAST_REFUSALS = 0.4, 10, 20
SEED = 20_250_707
#: Place of a cutoff between the posteriors of sound pairs (0) and planted defects (1).
NEAR_SOUND = 0.05

# Labels, placeholders, language names and function words.
LABELS = ("answer", "final answer", "the answer", "response", "result", "solution", "output", "antwort", "ergebnis", "lösung", "respuesta", "resultado", "solución", "réponse", "résultat", "solution", "ответ", "результат", "решение", "答案", "回答", "结果", "assistant", "a")
PLACEHOLDERS = ("null", "none", "nil", "n/a", "na", "nan", "undefined", "tbd", "todo", "empty", "blank", "placeholder", "no answer", "no response", "not available", "unknown", "xxx", "...")
LANGUAGES = {
    "en": "english englisch anglais inglés английском английски 英文 英语",
    "de": "german deutsch allemand alemán немецком немецки 德文 德语",
    "fr": "french französisch français francés французском французски 法文 法语",
    "es": "spanish spanisch espagnol español испанском испански 西班牙文 西班牙语",
    "ru": "russian russisch russe ruso русском русски 俄文 俄语",
    "zh": "chinese chinesisch chinois chino китайском китайски 中文 汉语",
}
FUNCTION_WORDS = {
    "en": "the of and to is that with this by as we it are be from at which about so for each what how would could many first",
    "de": "der die das und ist wir dass ein eine mit für den von zu im auf auch nicht etwa bei wenn daher pro sind zuerst man wie viele ich diese",
    "es": "el los las que por para con del al como hay unos una primero cada y cerca cuántos si se su es no me",
    "fr": "le les des et une pour par est dans nous ce il au du environ soit chaque combien donc je que cette sont",
}
REFUSALS = (
    # English
    r"\bI(?:['’]m| am)? ?(?:really |so |very )?(?:have to|must|need to|would rather|prefer to|am going to|['’]ll have to|will have to) (?:respectfully |politely )?(?:refuse|decline|pass)\b",
    r"\b(?:I|we)(?:['’]m| am|['’]re| are)? ?(?:can ?not|can['’]?t|could not|couldn['’]?t|not able to|unable to|will not|won['’]?t|won['’]?t be able to|will not be able to|not allowed to|not permitted to|not in a position to|must not)(?: be able to)? (?:assist|help|answer|provide|complete|respond|comply|fulfil|fulfill|discuss|do that|do this|support|process|continue|give (?:you )?an answer|offer|engage|address|share)\b",
    r"\b(?:not something|nothing) I(?: can|['’]m able to| am able to| could) (?:help|assist|answer|do|provide|discuss)\b",
    r"\b(?:goes?|is|would be|runs?) (?:against|outside|beyond|contrary to) (?:of )?(?:my|the|our) (?:guidelines|policy|policies|rules|instructions|scope|abilities|what I)\b",
    r"\bI(?: do not| don['’]?t| am not|['’]m not) (?:really )?(?:feel comfortable|comfortable|willing|prepared|feel able)\b",
    r"\bI(?: would|['’]d)? (?:rather not|prefer not to)\b",
    # German
    r"\b(?:kann|darf|möchte|werde|will) (?:ich )?(?:\w+ ){0,4}?(?:leider )?(?:\w+ ){0,4}?(?:nicht|keine\w*) (?:\w+ ){0,3}?(?:helfen|beantworten|weiterhelfen|antworten|erfüllen|unterstützen|bearbeiten|geben|behandeln)\b",
    r"\bmuss ich (?:\w+ ){0,3}?(?:ablehnen|verweigern)\b|\bich muss (?:\w+ ){0,4}?(?:ablehnen|verweigern)\b|\bich lehne (?:\w+ ){0,4}?ab\b",
    # Spanish
    r"\bno (?:me es posible|puedo|podré|podemos|estoy autorizad[oa] (?:a|para)|me siento cómod[oa]|soy capaz de|voy a|quiero) ?(?:\w+ ){0,2}?(?:ayudar|responder|contestar|atender|proporcionar|dar|asistir|completar|cumplir|respondiendo|resolver|tratar)\w*\b",
    r"\b(?:debo|tengo que|prefiero|me veo obligad[oa] a) (?:\w+ )?(?:rechazar|declinar|negarme|no (?:responder|tratar|contestar|atender))\b",
    # French
    r"\bne (?:peux|puis|pourrai|pouvons|suis) (?:pas|malheureusement pas|point)? ?(?:\w+ ){0,3}?(?:répondre|aider|traiter|fournir|donner|assister|satisfaire|autorisée?|en mesure|capable)\b|\bne peux pas (?:vous |t['’])?(?:aider|répondre)\b",
    r"\bdépasse ce que je (?:suis|peux)\b|\b(?:préfère|souhaite|veux) ne pas (?:\w+ )?(?:traiter|répondre|aider|donner)\b|\b(?:dois|suis obligée? de) (?:\w+ )?(?:refuser|décliner)\b",
    # Russian
    r"\bне (?:могу|смогу|можем|в состоянии|имею права|буду|вправе|готов[а]?)\b(?: \w+){0,4}? (?:ответ\w+|помочь|помогать|отвечать|выполнить|предоставить|обсуждать|дать)\b|\b(?:помочь|ответить|отвечать)\b(?: \w+){0,4}? не (?:смогу|могу|буду|в состоянии)\b",
    r"\b(?:вынужден[а]?|приходится|должен|должна|придётся|предпоч\w+)(?: \w+){0,3}? (?:отказ\w+|отклон\w+|не отвечать)\b",
    # Chinese
    r"(?:我|我们)?(?:不能|无法|不可以|不便|不会|没有办法|没办法|未能)[^。！？，,]{0,10}?(?:提供|回答|协助|帮助|帮忙|完成|处理|讨论|满足)|(?:拒绝|谢绝|婉拒)(?:回答|这|该|此|您|你)|(?:必须|只能|不得不)(?:拒绝|谢绝)",
)
_REFUSAL = re.compile("|".join(f"(?:{r})" for r in REFUSALS), re.I)
_THINK = re.compile(r"<(think|thinking|thought|reasoning)>.*?(?:</\1>|\Z)", re.S | re.I)
_TAG = re.compile(r"</?[a-z_|][^<>\n]{0,60}>", re.I)
_BOX = re.compile(r"\\(?:boxed|fbox|text|mathrm|mathbf)\b")
_FENCE = re.compile(r"^[ \t]*```[\w+-]*[ \t]*$", re.M)
_LABEL = re.compile(r"(?<![^\W_])(?:" + "|".join(map(re.escape, sorted(set(LABELS), key=len, reverse=True))) + r")\s*(?=[:：]|\W*\Z)", re.I)
_SENTENCE = re.compile(r"[^.!?。！？\n]*(?:[.!?。！？]+(?=\s|\Z|[\"'”»*_)]|[^\x00-\x7f])|\n+|\Z)|[^\n]+?(?:\n|\Z)", re.S)
_LABELLED_NUMBER = re.compile(r"(?:" + "|".join(map(re.escape, sorted(set(LABELS), key=len, reverse=True))) + r")\W*[:：]\W*[-+]?[\d.,/^*e× ]*\d\W*\Z", re.I)
_NAMES = {name: lang for lang, names in LANGUAGES.items() for name in names.split()}
_ASKED = re.compile(
    r"\b(?:reply|repl(?:y|ies)|answer|respond|response|write|explain|give)\b[^.?!\n]{0,50}?\b(?:in|into)\s+(?P<a>english|german|french|spanish|russian|chinese)\b"
    r"|\b(?:antwort\w*|schreib\w*|erklär\w*|gib)\b[^.?!\n]{0,50}?\b(?:auf|in)\s+(?P<b>deutsch|englisch|französisch|spanisch|russisch|chinesisch)\b"
    r"|\b(?:répon\w+|écri\w+|expliqu\w+|donne\w*)\b[^.?!\n]{0,50}?\ben\s+(?P<c>français|anglais|allemand|espagnol|russe|chinois)\b"
    r"|\b(?:respond\w*|contest\w*|escrib\w*|explic\w*|respuesta)\b[^.?!\n]{0,50}?\ben\s+(?P<d>español|inglés|francés|alemán|ruso|chino)\b"
    r"|(?:ответ\w*|отвеча\w*|напиш\w*|пиш\w*)[^.?!\n]{0,50}?(?:на|по)[ -](?P<e>русском|английском|немецком|французском|испанском|китайском|русски|английски|немецки|французски|испански|китайски)"
    r"|(?:用|以|使用)(?P<f>中文|汉语|英文|英语|德文|德语|法文|法语|西班牙文|西班牙语|俄文|俄语)",
    re.I,
)
_WORDS_OF = {w: lang for lang, words in FUNCTION_WORDS.items() for w in words.split()}
_WORD = re.compile(r"[^\W\d_]+")
_ALNUM = re.compile(r"[^\W_]")
_LETTERS = re.compile(r"[^\W_]+")
_HAN = re.compile("[\u4e00-\u9fff]+")


_OUTER = " \t\r\n\xa0*_#`$~:：-–—.…{}()[]\"'“”|>=\\"


@lru_cache(1)
def _hidden() -> re.Pattern:
    """Runs of control and format characters but line ends and tabs."""
    return re.compile("[" + "".join(re.escape(c) for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) in ("Cf", "Cc") and c not in "\n\t") + "]+")


def visible(text: str) -> str:
    return text if text.isascii() else _hidden().sub("", text)


def spoken(text: str) -> str:
    """What is left of a response without its thinking part."""
    return _THINK.sub(" ", text) if "<" in text else text


def without_tags(text: str) -> str:
    return _TAG.sub(" ", text) if "<" in text else text


def content(text: str) -> str:
    """What is left without thinking, tags, empty boxes, fences and labels: the answer's own words and numbers."""
    t = without_tags(spoken(text))
    t = _FENCE.sub(" ", t) if "```" in t else t
    t = (_BOX.sub(" ", t) if "\\" in t else t).strip(_OUTER)
    if t.casefold() not in PLACEHOLDERS:
        t = _LABEL.sub(" ", t).strip(_OUTER)
    return "" if t.casefold() in PLACEHOLDERS or not _ALNUM.search(t) else t


def letters(text: str) -> str:
    return "".join(_LETTERS.findall(text.casefold()))


def language(text: str) -> tuple[str | None, dict[str, int]]:
    """Main language of a text, or None if it has too few words of any, with the evidence for each."""
    han = 0 if text.isascii() else sum(map(len, _HAN.findall(text)))
    counts = dict.fromkeys(LANGUAGES, 0)
    cyrillic = latin = 0
    for w in _WORD.findall(text.casefold()):
        if "\u0400" <= w[0] <= "\u04ff":
            cyrillic += 1
        elif not "\u4e00" <= w[0] <= "\u9fff":
            latin += 1
            lang = _WORDS_OF.get(w)
            if lang:
                counts[lang] += 1
    # a word has about two characters in Chinese, and a function word comes about every third word elsewhere
    counts["zh"], counts["ru"] = han // 6, (cyrillic + 2) // 3 if cyrillic > 1 else 0
    best = max(counts, key=lambda k: counts[k])
    second = max(v for k, v in counts.items() if k != best)
    return (best if counts[best] >= 2 and counts[best] > 1.5 * second else None), counts


def asked_language(prompt: str) -> str | None:
    """The language that a prompt asks for in words, the last one if several."""
    last = None
    for last in _ASKED.finditer(prompt):
        pass
    return _NAMES[next(g for g in last.groups() if g).casefold()] if last is not None else None


@dataclass
class TextModels:
    """The fitted models; either may be missing."""

    language: GramModel | None = None
    refusal: GramModel | None = None

    @staticmethod
    def named(model: GramModel | None, texts: Sequence[str]) -> list[str | None]:
        """The class of each text, or None where the model is not sure."""
        if model is None or not len(texts):
            return [None] * len(texts)
        best, margin, letters = model.score(texts)
        sure = (best >= 0) & (margin >= SURE_MARGIN) & (letters >= SURE_LETTERS)
        return [model.classes[k] if ok else None for k, ok in zip(best, sure)]


def ends_early(text: str) -> bool:
    """Whether a response visibly stops before its end."""
    if re.search(r"<(think|thinking|thought|reasoning)>(?!.*</\1>)", text, re.S | re.I):
        return True
    t = without_tags(spoken(text)).strip()
    if not t:
        return False
    if t.count("```") % 2 or t.count("{") > t.count("}"):
        return True
    if re.search(r"[.!?。！？…\"”»’`)}\]$*]\Z", t):
        return False
    if _LABELLED_NUMBER.search(t) or not re.search(r"[^\W\d_]{2,}", t):
        return False
    return len(_WORD.findall(t)) > 3 or len(t) > 20


def _sentences(text: str) -> list[str]:
    return [s for s in _SENTENCE.findall(text) if s.strip()]


@lru_cache(16)
def prompt_facts(prompt: str) -> tuple[str, str | None, str | None]:
    """Letters, the language asked for and the main language of a prompt, which the samples of a group share."""
    return letters(prompt), asked_language(prompt), language(prompt)[0]


def pair_votes(prompts: Sequence[str | None], responses: Sequence[str | None], models: TextModels) -> list[int]:
    """``text_votes`` of many pairs, with the models applied to all of them at once."""
    return [votes for votes, *_ in judged(prompts, responses, models)]


def judged(prompts: Sequence[str | None], responses: Sequence[str | None], models: TextModels, search: bool = True) -> list[tuple[int, str | None, tuple]]:
    """(votes, the model's language of the prompt, kind of the response's language) of each pair.

    Without ``search`` the responses are known to have none of the sentences of ``REFUSALS``.
    """
    prompts, responses = ([t if isinstance(t, str) else None for t in texts] for texts in (prompts, responses))
    owns = [content(visible(r)) if r is not None else "" for r in responses]
    own_languages, refusals = TextModels.named(models.language, owns), TextModels.named(models.refusal, owns)
    each = list(dict.fromkeys(p for p in prompts if p))
    prompt_languages = dict(zip(each, TextModels.named(models.language, each)))
    out = []
    for p, r, own, own_language, refusal in zip(prompts, responses, owns, own_languages, refusals):
        kind = text_kind(own, own_language)
        out.append((text_votes(p, r, own, kind, prompt_languages.get(p), refusal, search), prompt_languages.get(p), kind))
    return out


def text_kind(own: str, own_language: str | None) -> tuple:
    """What the votes on languages ask of a text: (its main language, languages it has hardly any words of, the model's language)."""
    got, counts = language(own) if own else (None, dict.fromkeys(LANGUAGES, 0))
    return got, tuple(k for k in LANGUAGES if got and counts[k] * 4 <= counts[got]), own_language


def empty_votes(text: str, own: str) -> list[bool]:
    blank = not text.strip()
    return [blank, not blank and not own, not own and bool(_THINK.search(text))]


def copy_votes(p: str, said: str, own: str) -> list[bool]:
    """Votes of a response on being a copy of a prompt with the letters ``p``."""
    if not own or not p:
        return [False] * 3
    a, bare, besides = letters(without_tags(said)), letters(own), False
    if p in a:
        besides = len(letters(content(a.replace(p, " ")) or "")) == 0 or not _ALNUM.search(a.replace(p, ""))
        besides = besides or letters(_LABEL.sub(" ", a.replace(p, " "))) in ("", *map(letters, LABELS), "question", "prompt", "user")
    return [a == p or bare == p, besides, bare in p and 2 * len(bare) >= len(p) and len(bare) >= 12]


def language_votes(wanted: str | None, modelled: str | None, kind: tuple) -> list[bool]:
    """Votes on a text where one language is wanted by the words of the prompt, one by the model."""
    got, hardly, own_language = kind
    other = bool(wanted and got) and got != wanted
    return [other, other and wanted in hardly, bool(modelled and own_language) and own_language != modelled]


def packed(bits: Sequence[bool]) -> int:
    return sum(1 << i for i, b in enumerate(bits) if b)


def text_votes(prompt: str | None, response: str | None, own: str, kind: tuple, prompt_language: str | None = None, refusal: str | None = None, search: bool = True) -> int:
    """Bits of the votes that rest on the texts, in the order of ``FUNCTIONS``; ``own`` is the response's content, ``kind`` its language."""
    text = visible(response) if response is not None else ""
    bits = empty_votes(text, own)
    said = spoken(text)
    refusing = nothing_else = False
    if own and search and _REFUSAL.search(said.replace("\n", " ")):
        refusing = True
        rest = " ".join(s for s in _sentences(said) if not _REFUSAL.search(s.replace("\n", " ")))
        nothing_else = not re.search(r"\d", rest) and "\\boxed" not in rest
    elif own:
        nothing_else = not re.search(r"\d", own) and len(own) > 20
    bits += [refusing, nothing_else, refusal == "refusal" and not re.search(r"\d", own)]
    if own and prompt:
        own_letters, asked, words = prompt_facts(prompt)
        bits += copy_votes(own_letters, said, own) + language_votes(asked or words, asked or prompt_language, kind)
    else:
        bits += [False] * 6
    bits += [False, False, False, bool(own) and ends_early(text)]
    return packed(bits)


_ALL = [(d, f[0]) for d in DEFECTS for f in FUNCTIONS[d]]
_AT = {x: i for i, x in enumerate(_ALL)}


#: What a sound pair tells of defects planted into it, with bits: votes on the planted text plus 1, or numbers of ``CODES``; 0 is nothing.
MARKS = {"empty": 4, "copy": 4, "truncated": 5, "hedge": len(_ALL) + 1, "language": 3, "prompt": 6, "text": 12}
_SHIFT = dict(zip(MARKS, np.cumsum([0, *MARKS.values()]).tolist()))
CODES = {k: i for i, k in enumerate((None, *LANGUAGES))}
_N = len(CODES)


def prompt_code(words: str | None, modelled: str | None) -> int:
    return 1 + CODES[words] * _N + CODES[modelled]


def text_code(kind: tuple) -> int:
    """A number of a ``text_kind``."""
    got, hardly, own_language = kind
    return 1 + ((CODES[got] * _N + CODES[own_language]) << len(LANGUAGES)) + sum(1 << CODES[k] - 1 for k in hardly)


def pair_marks(index: Sequence[int], prompts: Sequence[str | None], responses: Sequence[str | None], models: TextModels) -> tuple[list[int], list[int]]:
    """Votes and ``MARKS`` of pairs; the marks of unsound pairs are 0."""
    got = judged(prompts, responses, models)
    votes, marks, hedged = [v for v, *_ in got], [0] * len(got), []
    for i, (v, modelled, kind) in enumerate(got):
        p, r = prompts[i], responses[i]
        if v or not isinstance(p, str) or not isinstance(r, str):
            continue
        own_letters, asked, words = prompt_facts(p)
        lang = modelled or words
        out = {k: 0 for k in MARKS} | {"language": CODES[lang]}
        cases = planted_into(p, r, lang, int(index[i]))
        text = visible(cases["empty"][0])
        out["empty"] = 1 + packed(empty_votes(text, content(text)))
        text = visible(cases["copy"][0])
        out["copy"] = 1 + packed(copy_votes(own_letters, spoken(text), content(text)))
        if "truncated" in cases:
            text, facts = cases["truncated"]
            early = False if text is r else bool(content(visible(text))) and ends_early(visible(text))
            out["truncated"] = 1 + pattern_of(facts | early << _AT["truncated", "text_ends_early"], "truncated")
        if lang and not asked:
            out["prompt"] = prompt_code(words, modelled)
        if lang and len(r) > LEAST_CHARS:
            out["text"] = text_code(kind)
        if lang == "en":
            hedged.append(i)
        marks[i] = sum(out[k] << _SHIFT[k] for k in MARKS)
    # the hedge is no refusal and ends a sentence, and the response has none
    for i, (v, *_) in zip(hedged, judged([prompts[i] for i in hedged], [HEDGE + responses[i] for i in hedged], models, search=False)):
        marks[i] += 1 + v << _SHIFT["hedge"]
    return votes, marks


def votes(samples: DataFrame, train_data: DataFrame, turns: DataFrame, models: TextModels) -> DataFrame:
    """(sample_index, votes, marks): the votes of all functions on each sample as bits, and the ``MARKS`` of sound ones."""
    shared = samples.sparkSession.sparkContext.broadcast(models)  # two tables of ``CELLS`` rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            voted, marks = pair_marks(b["sample_index"].tolist(), b["prompt"].tolist(), b["response"].tolist(), shared.value)
            yield pd.DataFrame({"sample_index": b["sample_index"], "session_id": b["session_id"], "status": b["status"], "created_at": b["created_at"], "votes": voted, "marks": marks})

    rows = samples.where("sample_index is not null").select("sample_index", "session_id", "status", F.unix_micros(F.col("created_at").cast("timestamp")).alias("created_at"), "prompt", "response")
    voted = rows.mapInPandas(run, "sample_index long, session_id string, status string, created_at long, votes int, marks long")
    latest = F.struct(F.coalesce("created_at", F.lit(0)), "votes", "marks")
    once = voted.groupBy("sample_index").agg(F.max(latest).alias("latest"), F.max_by("session_id", latest).alias("session_id"), F.max_by("status", latest).alias("status"))
    once = once.select("sample_index", "session_id", "status", "latest.votes", "latest.marks")
    flags = train_data.where("sample_indices is not null").groupBy(F.col("sample_indices").alias("sample_index")).agg(F.max("truncated").alias("flag"))
    ends = turns.where("session_id is not null and turn is not null").groupBy("session_id").agg(F.max_by("finish_reason", "turn").alias("finish"))
    bit = lambda name, cond: F.when(cond, 1 << _AT["truncated", name]).otherwise(0)
    joined = once.join(flags, "sample_index", "left").join(ends, "session_id", "left")
    mine = bit("status", F.col("status") == "truncated") + bit("flag", F.col("flag") == 1) + bit("finish_reason", F.col("finish") == "length")
    # a fact about a cut matters only where there is something to cut, which the order of defects sees to
    all_votes = (F.col("votes") + mine).cast("int")
    return joined.select("sample_index", all_votes.alias("votes"), F.when(all_votes == 0, F.col("marks")).otherwise(0).alias("marks"))


@dataclass
class LabelModel:
    """Share of defective pairs, and P(vote | defective), P(vote | sound) of each function."""

    prior: float
    hit: np.ndarray
    false: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """P(defective) of each pattern of votes."""
        on = (np.asarray(patterns)[:, None] >> np.arange(len(self.hit))) & 1
        yes = np.log(self.prior) + (on * np.log(self.hit) + (1 - on) * np.log1p(-self.hit)).sum(1)
        no = np.log1p(-self.prior) + (on * np.log(self.false) + (1 - on) * np.log1p(-self.false)).sum(1)
        return 1 / (1 + np.exp(np.clip(no - yes, -700, 700)))


def fit(patterns: np.ndarray, counts: np.ndarray, functions: tuple, rounds: int = 500, strength: float | None = None) -> LabelModel:
    """The label model of one defect, by EM over the counts of patterns with priors on the functions."""
    m = len(functions)
    on = (patterns[:, None] >> np.arange(m)) & 1
    hit0, false0 = np.array([f[1] for f in functions]), np.array([f[2] for f in functions])
    model = LabelModel(PRIOR, hit0, false0)
    n = counts.sum()
    if not n:
        return model
    weight = (STRENGTH if strength is None else strength) * n
    post = np.zeros(len(patterns))
    for _ in range(rounds):
        new = model.posterior(patterns)
        mass, rest = new * counts, (1 - new) * counts
        prior = float(np.clip((mass.sum() + PRIOR * weight) / (n + weight), 1e-6, 0.5))
        hit = np.clip(((mass[:, None] * on).sum(0) + hit0 * weight * PRIOR) / (mass.sum() + weight * PRIOR), 1e-6, 1 - 1e-6)
        false = np.clip(((rest[:, None] * on).sum(0) + false0 * weight) / (rest.sum() + weight), 1e-6, 1 - 1e-6)
        model = LabelModel(prior, hit, false)
        done = np.abs(new - post).max() < 1e-10
        post = new
        if done:
            break
    return model


def pattern_of(votes, defect: str):
    """The votes of one defect's functions, of numbers or arrays."""
    return (votes >> _AT[defect, FUNCTIONS[defect][0][0]]) & ((1 << len(FUNCTIONS[defect])) - 1)


def label_models(voted: DataFrame) -> dict[str, LabelModel]:
    """A fitted model per defect; a defect has at most 2**functions patterns."""
    out = {}
    patterns = [(F.shiftright("votes", _AT[d, FUNCTIONS[d][0][0]]).bitwiseAND(F.lit((1 << len(FUNCTIONS[d])) - 1))).alias(d) for d in DEFECTS]
    # one pass: each row counts once for each defect
    each = voted.select(F.explode(F.array(*[F.struct(F.lit(d).alias("defect"), p.alias("pattern")) for d, p in zip(DEFECTS, patterns)])).alias("x"))
    rows = bounded_rows(each.groupBy("x.defect", "x.pattern").agg(F.count("*").alias("n")), sum(1 << len(f) for f in FUNCTIONS.values()), "patterns of votes")
    for d in DEFECTS:
        mine = [(r["pattern"], r["n"]) for r in rows if r["defect"] == d] or [(0, 0)]
        out[d] = fit(np.array([p for p, _ in mine]), np.array([n for _, n in mine], float), FUNCTIONS[d])
    return out


# A refusing sentence in each language, a hedge in an answer.
PLANTED_REFUSALS = {
    "en": ("I'm sorry, but I can't help with that.", "I am not able to answer this question."), "de": ("Leider kann ich diese Frage nicht beantworten.",), "es": ("Lo siento, no puedo responder a esta pregunta.",),
    "fr": ("Je suis désolé, je ne peux pas répondre à cette question.",), "ru": ("К сожалению, я не могу ответить на этот вопрос.",), "zh": ("抱歉，我无法回答这个问题。",),
}
HEDGE = "I cannot give an exact figure, but a fair estimate works. "


def planted_into(p: str, r: str, lang: str | None, seed: int) -> dict[str, tuple[str, int]]:
    """(response, votes of facts) of each defect but another language planted into a sound pair; a response of a few words isn't cut."""
    pick = lambda defect, forms: forms[zlib.crc32(f"{SEED}|{seed}|{defect}".encode()) % len(forms)]
    fact = lambda name: 1 << _AT["truncated", name]
    out = {
        "empty": (pick("empty", ["", " \n", f"<think>{r}</think>", "\\boxed{}", "N/A", "**Answer:**", "null"]), 0),
        "refusal": (pick("refusal", PLANTED_REFUSALS[lang or "en"]), 0),
        "copy": (pick("copy", [p, p.upper(), f'"{p}"', f"Question: {p}", f"{p}\n{p}", p.lower()]), 0),
    }
    words = r.split(" ")
    if len(words) > 12:
        kept = words[: pick("words", range(6, len(words) - 3))]
        cut_text = " ".join(kept).rstrip(".!?。,:;") + " " + words[-4].strip(".!?。")[:3]
        out["truncated"] = pick("truncated", [(cut_text, 0), (cut_text, fact("finish_reason")), (r, fact("status")), (r, fact("flag")), (r, fact("finish_reason"))])
    return out


def planted(pairs: list[tuple[str, str]], languages: list[str | None]) -> dict[str, list[tuple[str, str, int]]]:
    """(prompt, response, votes of facts) with each defect but another language planted into sound pairs, by defect."""
    out: dict[str, list[tuple[str, str, int]]] = {d: [] for d in DEFECTS}
    for i, ((p, r), lang) in enumerate(zip(pairs, languages)):
        for d, (text, facts) in planted_into(p, r, lang, i).items():
            out[d].append((p, text, facts))
    return out


def best_cutoff(good: np.ndarray, bad: np.ndarray, good_weights: np.ndarray | None = None, bad_weights: np.ndarray | None = None, floor: float = 0.0) -> float:
    """The cutoff between posteriors of planted defects (``good``) and of sound pairs (``bad``) with the best F1.

    Between the last posterior that is left out and the first that is kept it lies near the former, as planted
    defects are plainer than real ones. Weights tell how many cases each posterior stands for; no cutoff is below ``floor``.
    """
    if not len(good):
        return 0.5
    good_weights, bad_weights = (np.ones(len(x)) if w is None else w for x, w in ((good, good_weights), (bad, bad_weights)))
    levels = np.unique(np.concatenate([[floor], good, bad]))
    levels = levels[levels >= floor]
    if len(levels) < 2:
        return 0.5
    hits, alarms = ((x[None, :] >= levels[1:, None]) @ w for x, w in ((good, good_weights), (bad, bad_weights)))
    f1 = 2 * hits / np.maximum(hits + alarms + good_weights.sum(), 1)
    k = int(f1.argmax())
    return float(levels[k] + NEAR_SOUND * (levels[k + 1] - levels[k]))


def labelled_texts(documents: DataFrame | None) -> DataFrame | None:
    """(lang, text, fold) of all documents that state one of the languages; equal texts have the same fold."""
    if documents is None:
        return None
    lang = F.lower(F.substring_index(F.replace(F.trim("lang"), F.lit("_"), F.lit("-")), "-", 1))
    rows = documents.where("text is not null").select(lang.alias("lang"), "text", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold"))
    return rows.where(F.col("lang").isin(*LANGUAGES))


def language_models(texts: DataFrame | None) -> list[GramModel | None]:
    """The language model of all labelled texts, then for each fold one that it has no part in; None without two languages.

    Where the other folds lack a language, the model of all texts serves.
    """
    if texts is None:
        return [None] * (1 + FOLDS)
    names = list(LANGUAGES)
    counts = counted(texts, lambda b: (b["text"].tolist(), b["fold"].to_numpy() * len(names) + b["lang"].map(names.index).to_numpy(int)), FOLDS * len(names))
    counts = counts.reshape(FOLDS, len(names), -1)
    whole, *others = (GramModel.of_counts(x, names) for x in (counts.sum(0), *(counts.sum(0) - counts[k] for k in range(FOLDS))))
    return [whole, *(m if m and m.classes == whole.classes else whole for m in others)]


def language_model(texts: DataFrame | None) -> GramModel | None:
    return language_models(texts)[0]


def refusal_model(samples: DataFrame) -> GramModel | None:
    """Refusals against other content, learned from what the sentences of ``REFUSALS`` say about all responses."""

    def examples(b: pd.DataFrame) -> tuple[list[str], np.ndarray]:
        owns = [own for r in b["response"] if (own := content(visible(r)))]
        return owns, np.array([bool(_REFUSAL.search(own.replace("\n", " "))) and not re.search(r"\d", own) for own in owns], int)

    counts = counted(samples.where("response is not null").select("response"), examples, 2)
    return GramModel.of_counts(counts, ("other", "refusal")) if counts[1, -1] >= LEAST_REFUSALS else None


def document_kinds(texts: DataFrame | None, models: Sequence[GramModel | None]) -> Counter:
    """(language, ``text_code``) of all labelled texts long enough to serve as answers, each judged by the model of the other folds."""
    if texts is None:
        return Counter()
    shared = texts.sparkSession.sparkContext.broadcast(list(models))  # tables of ``CELLS`` rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for b in batches:
            for fold, rows in b.groupby("fold"):
                owns = [content(visible(t)) for t in rows["text"]]
                kinds = map(text_kind, owns, TextModels.named(shared.value[fold], owns))
                seen.update((CODES[k], text_code(x)) for k, x in zip(rows["lang"], kinds))
        yield pd.DataFrame([(k, x, n) for (k, x), n in seen.items()], columns=["lang", "code", "n"])

    rows = texts.where(F.length("text") > LEAST_CHARS).mapInPandas(run, "lang int, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    return Counter({(r["lang"], r["code"]): r["n"] for r in bounded_rows(rows, _N << MARKS["text"], "kinds of texts")})


def mark(marks, name: str):
    """One of the ``MARKS`` of a number."""
    return (marks >> _SHIFT[name]) & ((1 << MARKS[name]) - 1)


def counts_of_marks(voted: DataFrame) -> dict[str, Counter]:
    """How often each mark has each value over all sound pairs; prompts and texts together with their language."""
    of = lambda name: F.shiftright("marks", _SHIFT[name]).bitwiseAND(F.lit((1 << MARKS[name]) - 1)).cast("int")
    each = F.array(*[F.struct(F.lit(k).alias("name"), (of("language") if k in ("prompt", "text") else F.lit(0)).alias("lang"), of(k).alias("value")) for k in MARKS])
    rows = voted.where("marks <> 0").select(F.explode(each).alias("x")).groupBy("x.name", "x.lang", "x.value").agg(F.count("*").alias("n"))
    out: dict[str, Counter] = defaultdict(Counter)
    for r in bounded_rows(rows, sum((_N if k in ("prompt", "text") else 1) << n for k, n in MARKS.items()), "kinds of marks"):
        out[r["name"]][(r["lang"], r["value"]) if r["name"] in ("prompt", "text") else r["value"]] += r["n"]
    return out


def planted_languages(prompts: Counter, texts: Counter) -> Counter:
    """Patterns of votes where each prompt meets, with a weight of 1 in all, the texts of the other languages, which weigh alike."""
    names = {i: k for k, i in CODES.items()}
    of: dict[int, list] = defaultdict(list)
    for (lang, code), n in texts.items():
        if code and lang:
            x, hardly = divmod(code - 1, 1 << len(LANGUAGES))
            of[lang].append(((names[x // _N], tuple(k for k in LANGUAGES if hardly >> CODES[k] - 1 & 1), names[x % _N]), n))
    out: Counter = Counter()
    for (lang, code), n in prompts.items():
        others = [k for k in of if k != lang]
        if not code or not others:
            continue
        wanted, modelled = (names[x] for x in divmod(code - 1, _N))
        for k in others:
            share = n / len(others) / sum(m for _, m in of[k])
            for kind, m in of[k]:
                out[packed(language_votes(wanted, modelled, kind))] += share * m
    return out


def cutoffs_of(counts: dict[str, Counter], foreign: Counter, texts: TextModels, models: dict[str, LabelModel]) -> dict[str, float]:
    """A cutoff per defect from the marks of all sound pairs, each of them once as it is and once with a hedge if English; 0.5 where none could be planted."""
    good: dict[str, Counter] = {d: Counter({v - 1: n for v, n in counts[d].items() if v}) for d in ("empty", "copy", "truncated")}
    good["refusal"] = Counter()
    for lang, n in counts["language"].items():
        forms = PLANTED_REFUSALS[next(k for k, i in CODES.items() if i == lang) or "en"]
        for v in pair_votes([None] * len(forms), forms, texts):
            good["refusal"][pattern_of(v, "refusal")] += n / len(forms)
    good["wrong_language"] = planted_languages(counts["prompt"], counts["text"] + foreign)
    plain, hedged = counts["language"].total(), Counter({v - 1: n for v, n in counts["hedge"].items() if v})
    out = {}
    for d in DEFECTS:
        bad = Counter({0: 2 * plain - hedged.total()})
        for v, n in hedged.items():
            bad[pattern_of(v, d)] += n
        (x, wx), (y, wy) = ((np.array(list(c), np.int64), np.array(list(c.values()), float)) for c in (good[d], bad))
        out[d] = best_cutoff(models[d].posterior(x), models[d].posterior(y), wx, wy, models[d].posterior(np.array([0]))[0])  # a pair without votes is never defective
    return out


def validated_cutoffs(pairs: list[tuple[str, str]], texts: TextModels, models: dict[str, LabelModel]) -> dict[str, float]:
    """The cutoffs by defects planted into the sound ones of a list of pairs, as ``labelled`` has them from whole tables."""
    _, marks = pair_marks(range(len(pairs)), [p for p, _ in pairs], [r for _, r in pairs], texts)
    counts: dict[str, Counter] = defaultdict(Counter)
    for m in filter(None, marks):
        for k in MARKS:
            counts[k][(mark(m, "language"), mark(m, k)) if k in ("prompt", "text") else mark(m, k)] += 1
    return cutoffs_of(counts, Counter(), texts, models)


def labelled(samples: DataFrame, train_data: DataFrame, turns: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """(sample_index, defects array in order, p_empty, ...): all defects above their cutoffs."""
    examples = labelled_texts(documents)
    languages, *others = language_models(examples)
    texts = TextModels(languages, refusal_model(samples))
    voted = cut(votes(samples, train_data, turns, texts))
    models = label_models(voted)
    cutoffs = cutoffs_of(counts_of_marks(voted), document_kinds(examples, others), texts, models)
    out = [F.col("sample_index")]
    kept = []
    for d in DEFECTS:
        first, m = _AT[d, FUNCTIONS[d][0][0]], len(FUNCTIONS[d])
        table = F.array(*[F.lit(float(x)) for x in models[d].posterior(np.arange(1 << m))])
        p = F.get(table, F.shiftright("votes", first).bitwiseAND(F.lit((1 << m) - 1)))
        kept.append(F.when(p >= cutoffs[d], F.lit(d)))
        out.append(F.round(p, 6).alias(f"p_{d}"))
    return voted.select(out[0], F.array_compact(F.array(*kept)).alias("defects"), *out[1:])


def found(samples: DataFrame, train_data: DataFrame, turns: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """(sample_index, defect): the first defect of each defective sample."""
    rows = labelled(samples, train_data, turns, documents).where(F.size("defects") > 0)
    return rows.select("sample_index", F.get("defects", F.lit(0)).alias("defect"))

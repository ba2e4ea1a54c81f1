"""Small fixed word lists per language, and columns built on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Common function words; a word that several languages write alike stands in each of them.
FUNCTION_WORDS = {
    "en": "a am an and are as at be before but do door every for from he in is it its me my no not of on one or our so some that the there these they this to until was we what when whether which while who will with you after".split(),
    "de": "am an auf bei bis da damit dass dem den der des die ein eine einem einen einer es für ich ihr im in ist jede jeden mit nach nicht ob ohne sich sie sind so solange um und von vor was weil wenn wie wird zu zum zur das".split(),
    "fr": "a après au aux avant avec ce ces cette chaque comme d dans de des dès du elle en est et il ils je jusqu l la le les mais me ne ou par pas pour qu que qui s sans se selon si sur tant te un une vous y".split(),
    "es": "a al antes aunque cada como con de del desde el ella en es esta este hasta la las lo los mas me mientras más nada ni no o para pero por porque que se según si sin sobre su sus tras un una y ya".split(),
    "pt": "a ao aos antes as até cada com como da das de depois do dos e ela ele em embora enquanto era foi mais mas me na nas no nos não o os ou para pela pelo por porque que quem se sem seu sua um uma à às é".split(),
    "nl": "aan al als bij dat de die dit door een elk elke en er geen had heeft het hij hoewel ik in is maar met na naar niet nog of om omdat ook op te tot totdat uit van voor was we wordt ze zich zijn zo zoals zodat zolang".split(),
    "ru": "без бы в во вы для до если и из или к как когда который мы на не ни но о об он она они от перед по пока после при с со так такой то только у хотя чтобы что это я".split(),
}

# Names of languages in the languages themselves and in each other.
LANGUAGE_NAMES = {
    "en": "english|englisch|englische|anglais|inglés|inglês|engels|английский",
    "de": "german|deutsch|deutsche|allemand|alemán|alemão|duits|немецкий",
    "fr": "french|französisch|französische|français|francés|francês|frans|французский",
    "es": "spanish|spanisch|spanische|espagnol|español|espanhol|spaans|испанский",
    "pt": "portuguese|portugiesisch|portugiesische|portugais|portugués|português|portugees|португальский",
    "nl": "dutch|niederländisch|niederländische|néerlandais|neerlandés|holandês|nederlands|голландский",
    "ru": "russian|russisch|russische|russe|ruso|russo|русский",
}
LANGUAGES = tuple(FUNCTION_WORDS)


def plain(text: Column) -> Column:
    """Letters and digits of any script, lowered, one blank between words."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def hits(words: Column, lang: str) -> Column:
    """How many different function words of lang occur."""
    return F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in FUNCTION_WORDS[lang]])))


def likeliest(words: Column, least: int = 1) -> Column:
    """The language with most different function words, if it leads; null if none or two lead alike."""
    each = F.array(*[F.struct(hits(words, x).alias("n"), F.lit(x).alias("lang")) for x in LANGUAGES])
    ranked = F.sort_array(each, asc=False)
    first, second = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
    return F.when((first["n"] >= least) & (first["n"] > second["n"]), first["lang"])

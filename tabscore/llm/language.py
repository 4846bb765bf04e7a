"""The language of a text, by its function words; its script, where these don't tell."""

from __future__ import annotations

#: Frequent function words of one language each. Fixed values.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for was with as on be at by this are from or an not have which",
    "de": "der die und das ist nicht ein eine zu den mit von dem auf für sich des im auch als wie nach bei",
    "fr": "le la les et des est une du que qui dans pour pas sur au avec ce il sont plus par ne se",
    "es": "el los las y que en un una por con del para es como más pero su al lo se está son",
}
LEAST_SHARE = 0.02
LONGEST = max(len(w.encode()) for words in FUNCTION_WORDS.values() for w in words.split())


class Language:
    def __init__(self):
        self.of: dict[bytes, tuple[str, ...]] = {}
        for language, words in FUNCTION_WORDS.items():
            for w in words.split():
                self.of[w.encode()] = (*self.of.get(w.encode(), ()), language)

    def votes(self, word: bytes) -> list[float] | None:
        """What a word says for each language: 1 for a function word of one, shares for that of several; null for others."""
        languages = self.of.get(word.lower()) if len(word) <= LONGEST else None
        return [(language in languages) / len(languages) for language in FUNCTION_WORDS] if languages else None

    def told(self, votes: list[float], n_words: int, text: bytes) -> str:
        """en, de, fr or es if their votes are frequent enough; else latin, if most letters are Latin, or other."""
        best = max(range(len(votes)), key=votes.__getitem__)
        if n_words and votes[best] >= LEAST_SHARE * n_words:
            return list(FUNCTION_WORDS)[best]
        if text.isascii():
            return "latin"
        letters = [c for c in text.decode("utf-8", "replace") if c.isalpha()]
        return "latin" if 2 * sum(c < "ɐ" for c in letters) >= len(letters) else "other"

    def __call__(self, text: bytes) -> str:
        words = text.lower().split()
        votes = dict.fromkeys(FUNCTION_WORDS, 0.0)
        for languages in filter(None, map(self.of.get, words)):
            for language in languages:
                votes[language] += 1 / len(languages)
        return self.told(list(votes.values()), len(words), text)

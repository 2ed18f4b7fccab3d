"""Word lists, phrases and patterns.

Two kinds of data live here:

* FIXED VALUES that define the results of the style features. They must equal the values the
  feature definitions use, so they are stated plainly, in natural order, as given.
* The built-in annotator's closed-class word lists (our own, see README "Annotations"): they stand
  in for a tagger and can be replaced by a caller-supplied lexicon table.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------------------------
# FIXED VALUES (feature definitions) -- do not edit
# ---------------------------------------------------------------------------------------------

WH_WORDS = ["who", "what", "when", "where", "why", "how"]
FUNCTION_POS_TAGS = ["PRON", "ADP", "DET", "CCONJ", "SCONJ", "PART", "AUX"]
FIRST_PERSON = ["i", "me", "my", "mine", "we", "us", "our", "ours"]
SECOND_PERSON = ["you", "your", "yours", "u", "ur"]
THIRD_PERSON = ["he", "him", "his", "she", "her", "they", "them", "their", "theirs"]

MODAL_WORDS = [
    "can", "could", "may", "might", "must", "shall", "should", "will", "would",
    "ought", "probably", "possibly", "certainly", "definitely", "undoubtedly",
    "clearly", "evidently",
]

DISCOURSE_MARKERS = [
    "however", "moreover", "therefore", "thus", "meanwhile", "in fact", "furthermore",
    "nevertheless", "anyway", "nonetheless", "on the other hand", "by contrast",
    "similarly", "also", "instead", "for example", "for instance",
]

SARCASM_MARKERS = [
    "yeah right", "sure jan", "as if", "oh great", "lucky me", "just perfect", "awesome", "love that for you",
    "i'm so sure", "can't wait", "what a surprise", "wow", "fantastic", "brilliant", "amazing",
]

LIWC_ANALYTIC = ["therefore", "thus", "consequently", "in conclusion", "resulted", "hence"]
LIWC_AFFECTIVE = ["happy", "sad", "angry", "fear", "hate", "love", "joy", "cry", "laugh", "terrible", "amazing"]
LIWC_AUTHENTICITY = FIRST_PERSON
LIWC_CERTAINTY = ["always", "never", "definitely", "certainly", "must", "undeniable"]
LIWC_TENTATIVENESS = ["maybe", "perhaps", "possibly", "seems", "guess", "kind of", "sort of", "i think"]

LIWC_CATEGORIES = {
    "liwc_analytic_count": LIWC_ANALYTIC,
    "liwc_affective_count": LIWC_AFFECTIVE,
    "liwc_authenticity_count": LIWC_AUTHENTICITY,
    "liwc_certainty_count": LIWC_CERTAINTY,
    "liwc_tentativeness_count": LIWC_TENTATIVENESS,
}

# Pattern-type rules, applied in this order to the stripped, lowercased sentence.
PATTERN1_PREFIXES = ["r/"]
PATTERN1_PHRASES = ["moderator applications", "consider !"]
PATTERN2_REGEXES = [
    r"\bin general, be courteous\b",
    r"\bpermanent ban\b",
    r"\bviolations of rule[s]?\b",
    r"\bquestions regarding.*media outlets\b",
    r"\bapproved domains list\b",
    r"\bplease review our rules\b",
]
PATTERN3_PHRASES = ["i am a bot"]
PATTERN3_PREFIXES = ["please if you have any questions"]
PATTERN4_PREFIXES = ["edit", "update:"]

RHETORICAL_FIRST_WORDS = ["what", "why", "how", "is", "are", "do", "can", "should"]
CLAUSE_DEPS = ["relcl", "advcl", "ccomp", "xcomp"]
QUOTE_CHARS = "\"“”‘’"
REPEATED_PUNCT_REGEX = r"(!{2,}|\?{2,}|\.{3,})"
# Formality: 50 + 0.5 * (sum of PLUS tags - sum of MINUS tags) / tokens; 50 when there are no tokens.
FORMALITY_PLUS = ["NOUN", "ADJ", "ADP", "DET"]
FORMALITY_MINUS = ["PRON", "VERB", "ADV", "INTJ"]

# Presets: name -> (remove_punct, remove_stopwords, lemmatize, include_pos); per-difficulty choice.
PRESETS = {
    "C1": (True, True, True, True),
    "C2": (True, True, False, True),
    "C3": (True, False, False, True),
    "C4": (True, False, True, True),
    "C5": (False, True, True, True),
    "C6": (False, True, False, True),
    "C7": (False, False, False, True),
    "C8": (False, False, True, True),
    "C9": (True, True, True, False),
    "C10": (True, True, False, False),
    "C11": (True, False, False, False),
    "C12": (True, False, True, False),
    "C13": (False, True, True, False),
    "C14": (False, True, False, False),
    "C15": (False, False, False, False),
    "C16": (False, False, True, False),
}
DIFFICULTY_PRESET = {"easy": "C3", "medium": "C14", "hard": "C9"}
DIFFICULTIES = ["easy", "medium", "hard"]

# Keys smoothed by the centred window after pair assembly; window 3.
SMOOTH_KEYS = [
    "sbert_cosine_similarity", "cosine_similarity", "sbert_cosine_distance", "sbert_directional_cosine",
    "wan_cosine_drift", "deep_style_cosine", "pos_trigram_cosine", "wan_euclidean_drift",
]
INCREASED_KEYS = ["average_clustering", "average_degree", "pos_density", "pos_avg_degree"]
DEEP_STYLE_KEYS = ["formality_score", "clause_complexity"]
DECISION_THRESHOLD = 0.35
WINDOW_SIZE = 3
DRIFT_SKIPS = [1, 2, 3]

# ---------------------------------------------------------------------------------------------
# Built-in annotator lexicon (ours; replaceable by a caller table)
# ---------------------------------------------------------------------------------------------

CLOSED_CLASS = {
    "PRON": ["i", "me", "my", "mine", "myself", "we", "us", "our", "ours", "ourselves", "you", "your",
             "yours", "yourself", "yourselves", "he", "him", "his", "himself", "she", "her", "hers",
             "herself", "it", "its", "itself", "they", "them", "their", "theirs", "themselves", "who",
             "whom", "whose", "someone", "anyone", "everyone", "nobody", "something", "anything",
             "everything", "nothing", "u", "ur"],
    "DET": ["the", "a", "an", "this", "that", "these", "those", "each", "every", "some", "any", "no",
            "all", "both", "either", "neither", "another", "which", "what"],
    "ADP": ["in", "on", "at", "by", "for", "with", "about", "against", "between", "into", "through",
            "during", "before", "after", "above", "below", "to", "from", "up", "down", "of", "off",
            "over", "under", "across", "around", "near", "without", "within", "along", "among", "upon",
            "toward", "towards", "behind", "beyond", "via"],
    "CCONJ": ["and", "but", "or", "nor", "yet", "so"],
    "SCONJ": ["because", "although", "though", "while", "whereas", "if", "unless", "whether", "until",
              "once", "since"],
    "PART": ["not", "n't"],
    "AUX": ["be", "am", "is", "are", "was", "were", "been", "being", "have", "has", "had", "do", "does",
            "did", "will", "would", "shall", "should", "can", "could", "may", "might", "must"],
    "INTJ": ["oh", "wow", "hey", "yes", "yeah", "ok", "okay", "hello", "hi", "ah", "oops", "uh", "um"],
    "ADV": ["very", "too", "also", "just", "only", "then", "there", "here", "now", "never", "always",
            "often", "again", "still", "even", "however", "thus", "therefore", "perhaps", "maybe",
            "where", "when", "why", "how"],
}

# Suffix rules for open-class words, first match wins (tag, Java/RE2-compatible regex on lowercase).
OPEN_CLASS_RULES = [
    ("NUM", r"^\p{N}+$"),
    ("ADV", r"^\p{L}+ly$"),
    ("VERB", r"^\p{L}+(ing|ed)$"),
    ("ADJ", r"^\p{L}+(ous|ful|ive|able|ible|less|ish|ical)$"),
]

# Lemma suffix rules on lowercase alphabetic words longer than 4 chars: (suffix regex, replacement).
LEMMA_RULES = [
    (r"ies$", "y"),
    (r"ing$", ""),
    (r"ed$", ""),
    (r"([^s])s$", "$1"),
]

# Sentiment stand-in lexicon (ours): word, polarity, subjectivity.
SENTIMENT_LEXICON = [
    ("good", 0.7, 0.6), ("great", 0.8, 0.75), ("excellent", 1.0, 1.0), ("nice", 0.6, 1.0),
    ("happy", 0.8, 1.0), ("love", 0.5, 0.6), ("best", 1.0, 0.3), ("amazing", 0.6, 0.9),
    ("wonderful", 1.0, 1.0), ("beautiful", 0.85, 1.0), ("fantastic", 0.4, 0.9), ("awesome", 1.0, 1.0),
    ("bad", -0.7, 0.67), ("terrible", -1.0, 1.0), ("awful", -1.0, 1.0), ("sad", -0.5, 1.0),
    ("worst", -1.0, 1.0), ("hate", -0.8, 0.9), ("poor", -0.4, 0.6), ("wrong", -0.5, 0.9),
    ("angry", -0.5, 1.0), ("ugly", -0.7, 1.0), ("boring", -1.0, 1.0), ("horrible", -1.0, 1.0),
    ("interesting", 0.5, 0.5), ("important", 0.4, 1.0), ("clear", 0.1, 0.4), ("sure", 0.5, 0.9),
    ("easy", 0.43, 0.83), ("hard", -0.29, 0.54), ("new", 0.14, 0.45), ("old", 0.1, 0.2),
]

# Readability: vowels for syllable groups (lowercase), and the readability constants of the
# published Flesch, Gunning fog, ARI and Dale-Chall formulas.
SYLLABLE_VOWELS = "aeiouyàáâäãåèéêëìíîïòóôöõùúûüýÿæœ"

# Code points with Unicode's Emoji property (digits, # and * left out), as hexadecimal ranges.
EMOJI_RANGES = """
00A9 00AE 203C 2049 2122 2139 2194-2199 21A9-21AA 231A-231B 2328 23CF 23E9-23F3 23F8-23FA 24C2 25AA-25AB 25B6 25C0
25FB-25FE 2600-2604 260E 2611 2614-2615 2618 261D 2620 2622-2623 2626 262A 262E-262F 2638-263A 2640 2642 2648-2653
265F-2660 2663 2665-2666 2668 267B 267E-267F 2692-2697 2699 269B-269C 26A0-26A1 26A7 26AA-26AB 26B0-26B1 26BD-26BE
26C4-26C5 26C8 26CE-26CF 26D1 26D3-26D4 26E9-26EA 26F0-26F5 26F7-26FA 26FD 2702 2705 2708-270D 270F 2712 2714 2716
271D 2721 2728 2733-2734 2744 2747 274C 274E 2753-2755 2757 2763-2764 2795-2797 27A1 27B0 27BF 2934-2935 2B05-2B07
2B1B-2B1C 2B50 2B55 3030 303D 3297 3299 1F004 1F0CF 1F170-1F171 1F17E-1F17F 1F18E 1F191-1F19A 1F1E6-1F1FF
1F201-1F202 1F21A 1F22F 1F232-1F23A 1F250-1F251 1F300-1F321 1F324-1F393 1F396-1F397 1F399-1F39B 1F39E-1F3F0
1F3F3-1F3F5 1F3F7-1F4FD 1F4FF-1F53D 1F549-1F54E 1F550-1F567 1F56F-1F570 1F573-1F57A 1F587 1F58A-1F58D 1F590
1F595-1F596 1F5A4-1F5A5 1F5A8 1F5B1-1F5B2 1F5BC 1F5C2-1F5C4 1F5D1-1F5D3 1F5DC-1F5DE 1F5E1 1F5E3 1F5E8 1F5EF 1F5F3
1F5FA-1F64F 1F680-1F6C5 1F6CB-1F6D2 1F6D5-1F6D7 1F6DC-1F6E5 1F6E9 1F6EB-1F6EC 1F6F0 1F6F3-1F6FC 1F7E0-1F7EB 1F7F0
1F90C-1F93A 1F93C-1F945 1F947-1F9FF 1FA70-1FA7C 1FA80-1FA88 1FA90-1FABD 1FABF-1FAC5 1FACE-1FADB 1FAE0-1FAE8
1FAF0-1FAF8
"""
#: Spans all of the above; a text without any of these characters needs no test of the 148 ranges.
EMOJI_SPAN = r"[\x{A9}\x{AE}\x{203C}-\x{3299}\x{1F004}-\x{1FAF8}]"
EMOJI_CLASS = "[" + "".join("-".join(f"\\x{{{end}}}" for end in r.split("-")) for r in EMOJI_RANGES.split()) + "]"


def closed_class_rows() -> list[tuple[str, str]]:
    """(word, upos) rows; the first tag listed for a word wins."""
    seen: dict[str, str] = {}
    for tag, words in CLOSED_CLASS.items():
        for w in words:
            seen.setdefault(w, tag)
    return sorted(seen.items())


def stopwords() -> list[str]:
    """Built-in stop list: every closed-class word (a rule, not a transcribed list)."""
    return sorted({w for words in CLOSED_CLASS.values() for w in words})

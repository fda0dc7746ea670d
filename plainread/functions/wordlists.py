"""Word lists, constants and patterns.

The connective lists, first-person list, cohesion lists, feature order and
linear weights are fixed values that results depend on; they are stated as
plain text.  The closed-class lists feed the rule annotator.
"""

from __future__ import annotations

# --- fixed values: rule set -------------------------------------------------

FIRST_PERSON = ["i", "me", "my", "mine", "myself", "we", "us", "our", "ours", "ourselves"]

CONNECTIVES = {
    "causal": [
        "because", "since", "as", "so", "therefore", "thus", "hence", "consequently",
        "due to", "owing to", "for this reason", "as a result",
    ],
    "temporal": [
        "before", "after", "then", "when", "while", "as soon as", "once", "until", "since",
        "as", "meanwhile", "subsequently", "eventually", "at the same time", "later", "earlier",
    ],
    "logical": [
        "if", "then", "only if", "provided that", "in order that", "otherwise", "hence",
        "therefore", "thus", "so", "because", "as a result", "consequently",
    ],
    "additive": [
        "and", "also", "too", "as well as", "moreover", "furthermore", "in addition",
        "besides", "additionally", "not only... but also",
    ],
    "adversative": [
        "but", "however", "yet", "although", "though", "whereas", "on the other hand",
        "nevertheless", "nonetheless", "despite", "in contrast", "instead", "even though",
        "while",
    ],
}

# --- fixed values: cohesion word lists (not the rule-set lists) --------------

CAUSAL_COHESION = ["because", "therefore", "so", "thus", "hence"]
TEMPORAL_COHESION = ["then", "next", "after", "before", "subsequently"]
INTENTIONAL_COHESION = ["aim", "plan", "intend", "try"]

# --- fixed values: order of the 48-entry feature vector ----------------------

FEATURES = [
    "nouns", "verbs", "adjectives", "adverbs", "pronouns",
    "first_person_pronouns", "third_person_pronouns",
    "avg_syllables_per_word", "avg_word_frequency_log", "avg_content_word_frequency_log",
    "avg_age_of_acquisition", "avg_concreteness", "avg_imagery", "avg_familiarity",
    "avg_polysemy",
    "word_count", "sentence_length", "function_to_content_ratio",
    "connectives_total", "causal_connectives", "temporal_connectives",
    "logical_connectives", "additive_connectives", "adversative_connectives",
    "dependency_depth", "modifiers_per_np", "words_before_main_verb", "passive_constructions",
    "content_overlap_adjacent", "content_overlap_all", "noun_overlap_adjacent",
    "argument_overlap_adjacent", "stem_overlap_all",
    "lsa_overlap_adjacent", "lsa_overlap_all", "lsa_given_new", "lsa_verb_overlap_adjacent",
    "pos_dissimilarity_prev", "word_dissimilarity_prev",
    "causal_cohesion", "intentional_cohesion", "temporal_cohesion",
    "verb_overlap_adjacent", "verb_tense_repetition", "verb_aspect_repetition",
    "type_token_ratio", "lexical_diversity_all", "lexical_diversity_verbs",
]

# --- fixed values: the published linear weights, in FEATURES order -----------

SAVED_INTERCEPT = -4.499577881877133
SAVED_COEFFICIENTS = [
    -0.088266159336541, 0.011261664139272182, -0.08371292848928866, -0.1488981954728933,
    0.02865191709099111, -2.84598733468755e-14, 0.02865191709104524, -1.7274088796201794,
    0.9883285927637239, 0.9182299834250419, -0.0015656550911003898, 0.0005937006996858318,
    0.0073098642499904295, -0.004308319355230254, 2.622468214807938e-15,
    -0.0024590607456707768, -0.0006719443666578036, -2.942091015256665e-15,
    3.4416913763379853e-15, -0.19634904930696703, 0.1344784513025958, 0.20708907706381577,
    0.1201252885549176, 0.05916482126132685, -0.012212066158577783, 1.6653345369377348e-15,
    -0.004824349180924538, -1.7763568394002505e-15, -0.8149235931817121,
    -8.881784197001252e-16, -0.15568317862342068, -0.07523744645543133, 1.5294426691273726,
    0.36779477774827696, -0.8391161506790809, -3.9590807206662597, -0.01870310582282898,
    0.4014297708101335, -0.08529992537324767, -3.517394881670516, 14.864497163759939,
    1.150550456409992, -0.19857311969426258, 0.13455601019659238, -0.10109686018621028,
    0.6732964890060905, 2.0308245305874957, -0.4731355932488017,
]

# --- fixed values: columns of the training and norms files -------------------

TRAIN_ID, TRAIN_TEXT, TRAIN_LABEL, TRAIN_SPLIT = "ID", "Excerpt", "BT Easiness", "Kaggle split"
TRAIN_SCORES = {
    "flesch_reading_ease": "Flesch-Reading-Ease",
    "flesch_kincaid_grade": "Flesch-Kincaid-Grade-Level",
    "ari": "Automated Readability Index",
    "smog": "SMOG Readability",
    "new_dale_chall": "New Dale-Chall Readability Formula",
}
TRAIN_RIVALS = {
    "first": "firstPlace_pred", "second": "secondPlace_pred", "third": "thirdPlace_pred",
    "fourth": "fourthPlace_pred", "fifth": "fifthPlace_pred", "sixth": "sixthPlace_pred",
}
NORMS_WORD = "Word"
NORMS_COLUMNS = {
    "aoa": "Age of Acquisition Rating", "concreteness": "Concreteness",
    "familiarity": "Familiarity", "imagery": "Imageability",
}

EMBEDDING_WIDTH = 384

# --- part-of-speech classes used by the features ------------------------------

#: Tags a listed word may have besides its first.
AMBIGUOUS_WORDS = {
    "that": ["SCONJ", "DET", "PRON"], "this": ["DET", "PRON"], "these": ["DET", "PRON"], "those": ["DET", "PRON"],
    "her": ["PRON", "DET"], "his": ["DET", "PRON"], "to": ["PART", "ADP"], "as": ["SCONJ", "ADP", "ADV"],
    "so": ["ADV", "SCONJ"], "since": ["SCONJ", "ADP"], "until": ["SCONJ", "ADP"], "before": ["SCONJ", "ADP", "ADV"],
    "after": ["SCONJ", "ADP", "ADV"], "than": ["SCONJ", "ADP"], "like": ["ADP", "VERB", "SCONJ"], "one": ["NUM", "PRON"],
    "all": ["DET", "PRON", "ADV"], "some": ["DET", "PRON"], "any": ["DET", "PRON"], "both": ["DET", "PRON", "CCONJ"],
    "more": ["ADJ", "ADV", "PRON"], "most": ["ADJ", "ADV", "PRON"], "have": ["AUX", "VERB"], "has": ["AUX", "VERB"],
    "had": ["AUX", "VERB"], "do": ["AUX", "VERB"], "does": ["AUX", "VERB"], "did": ["AUX", "VERB"],
    "up": ["ADP", "ADV"], "down": ["ADP", "ADV"], "over": ["ADP", "ADV"], "out": ["ADP", "ADV"],
}
#: Tags a word that is not listed may have, by the tag its form gives.
OPEN_CHOICES = {"NOUN": ["NOUN", "VERB", "ADJ"], "VERB": ["VERB", "NOUN", "ADJ"], "ADJ": ["ADJ", "NOUN", "ADV"],
                "ADV": ["ADV", "ADJ"], "PROPN": ["PROPN", "NOUN", "ADJ"]}
CONTENT_POS = ["NOUN", "VERB", "ADJ", "ADV"]
FREQUENCY_POS = ["NOUN", "PROPN", "VERB", "ADJ", "ADV"]
CONJUNCTION_POS = ["CCONJ", "SCONJ"]
ARGUMENT_DEP = ["nsubj", "dobj"]
PASSIVE_DEP = ["nsubjpass", "auxpass"]
#: Labels of what modifies a noun.
MODIFIER_DEP = ["det", "amod", "nummod", "nmod", "compound", "poss", "appos", "acl", "relcl"]
NOUN_POS = ["NOUN", "PROPN"]

# --- closed-class words of the rule annotator ---------------------------------

CLOSED_CLASS = {
    "PART": ["not", "to"],
    "DET": ["the", "a", "an", "this", "these", "those", "each", "every", "some", "any", "no",
            "both", "all", "another"],
    "PRON": FIRST_PERSON + [
        "you", "your", "yours", "yourself", "he", "him", "his", "himself", "she", "her",
        "hers", "herself", "it", "its", "itself", "they", "them", "their", "theirs",
        "themselves", "who", "whom", "whose", "which", "what", "that", "someone", "anyone",
        "everyone", "nobody", "something", "anything", "everything", "nothing"],
    "AUX": ["am", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had",
            "having", "do", "does", "did", "will", "would", "shall", "should", "can", "could",
            "may", "might", "must"],
    "CCONJ": ["and", "or", "but", "nor", "yet", "so"],
    "SCONJ": ["because", "since", "as", "if", "while", "although", "though", "whereas",
              "when", "once", "until", "unless", "whether", "before", "after"],
    "ADP": ["of", "in", "on", "at", "by", "for", "with", "from", "into", "onto", "over",
            "under", "about", "between", "through", "during", "against", "among", "toward",
            "without", "within", "despite", "upon", "across", "behind", "beyond"],
    "ADV": ["never", "very", "then", "also", "too", "however", "therefore", "thus", "hence",
            "here", "there", "now", "again", "often", "always", "soon", "just", "instead",
            "otherwise", "moreover", "furthermore", "besides", "meanwhile", "later",
            "earlier", "nevertheless", "nonetheless", "next", "quite", "rather"],
    "NUM": ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten"],
}
BE_FORMS = ["am", "is", "are", "was", "were", "be", "been", "being"]
HAVE_FORMS = ["have", "has", "had", "having"]
NEGATIONS = ["not", "no", "never", "nt"]

# suffix: (shortest word it applies to, tag, letters to drop for the lemma, to add)
SUFFIX_RULES = {
    "ly": (4, "ADV", 0, ""),
    "ing": (5, "VERB", 3, ""), "ied": (4, "VERB", 3, "y"), "ed": (4, "VERB", 2, ""),
    "ble": (5, "ADJ", 0, ""), "ful": (5, "ADJ", 0, ""), "ous": (5, "ADJ", 0, ""),
    "ive": (5, "ADJ", 0, ""),
    "ies": (5, "NOUN", 3, "y"), "sses": (5, "NOUN", 2, ""), "xes": (5, "NOUN", 2, ""),
    "ches": (5, "NOUN", 2, ""), "shes": (5, "NOUN", 2, ""),
    "ss": (2, "NOUN", 0, ""), "us": (2, "NOUN", 0, ""), "is": (2, "NOUN", 0, ""),
    "s": (4, "NOUN", 1, ""),
}

# Irregular word form -> lemma; the verb forms are also what the annotator tags
# as past-tense verbs beyond the "-ed" rule.
IRREGULAR_PAST = {
    "went": "go", "said": "say", "made": "make", "saw": "see", "took": "take", "came": "come",
    "got": "get", "sat": "sit", "ran": "run", "knew": "know", "gave": "give", "found": "find",
    "told": "tell", "thought": "think", "left": "leave", "kept": "keep", "held": "hold",
    "wrote": "write", "stood": "stand", "brought": "bring",
}
BASE_VERBS = ["go", "say", "make", "see", "take", "come", "get", "sit", "run", "know", "give",
              "find", "tell", "think", "leave", "keep", "hold", "write", "stand", "bring",
              "aim", "plan", "intend", "try"]
IRREGULAR_NOUNS = {"men": "man", "women": "woman", "children": "child", "feet": "foot",
                   "teeth": "tooth", "mice": "mouse", "people": "person"}

# --- patterns ------------------------------------------------------------------

SENTENCE_PATTERN = r"[^.!?\n]+[.!?]*"
TOKEN_PATTERN = r"\p{L}+|\p{N}+|[^\p{L}\p{N} \t\n\f\r\x0B]"
WORD_PATTERN = r"\p{L}+"
VISIBLE_PATTERN = r"[^ \t\n\f\r\x0B]"
VOWEL_RUN = "[aeiouy]+"

"""Values that are part of the results and must not change."""

# English stop words. Apostrophe-free on purpose: the token
# "don't" keeps its apostrophe and is therefore not a stop word.
STOP_WORDS = """
a about above after again against all also am an and any are aren arent as at
be because been before being below between both but by
can cannot cant could couldn couldnt
did didn didnt do does doesn doesnt doing don dont down during
each etc
few for from further
had hadn hadnt has hasn hasnt have haven havent having he hed hell her here
heres hers herself hes him himself his how hows
i id if ill im in into is isn isnt it its itself ive
let lets
may me might more most mustn mustnt my myself
no nor not
of off on once only or other ought our ours ourselves out over own
same shall shan shant she shed shell shes should shouldn shouldnt so some such
than that thats the their theirs them themselves then there theres these they
theyd theyll theyre theyve this those through to too
under until up us
very
was wasn wasnt we wed well were weren werent weve what whats when whens where
wheres which while who whom whos why whys will with won wont would wouldn wouldnt
you youd youll youre yours yourself yourselves your youve
""".split()

# Limits and defaults.
LARGE_PAGES = 300             # a document of more pages gets a warning
FEW_CHARS = 30                # below this a document counts as unreadable
SECTION_MIN_CHARS = 15        # a section is longer than this
TRAIN_MIN_CHARS = 10          # a training text is longer than this
PREDICT_MIN_CHARS = 10        # a text to classify has at least this many
KEYWORD_MIN_WORDS = 3
KEYWORD_TOP_N = 15
SEARCH_TOP_K = 5
SEARCH_THRESHOLD = 0.05
SEARCH_FALLBACK_THRESHOLD = 0.005
WORDS_PER_MINUTE = 200
VOCABULARY_CAP = 4000
TEST_SHARE = 0.20
SPLIT_SEED = 42
INVERSE_REGULARISATION = 4.0
MAX_ITERATIONS = 1000
UNDETERMINED = "Undetermined"
TOO_BRIEF_MESSAGE = "Text is too brief for confident classification."

# Document metadata defaults.
METADATA_DEFAULTS = {
    "title": "Untitled",
    "author": "Unknown",
    "subject": "",
    "producer": "",
    "creation_date": "",
}
TEXT_METADATA = {"format": "Plain Text"}

"""Word lists and text cues of the opinion rules.

The lists are this project's own choice; version them together with the rules
that read them (see ``RULES_VERSION``).
"""

RULES_VERSION = "token-grounding-1"

# Words carrying no topic.
STOPWORDS = (
    "a about actually an and any are as at be been but by can could did do does doing don't for "
    "from had has have he her him his how i i'm if in into is it it's its just me my no not of on "
    "or our out over really she should so some than that that's the their them then there these "
    "they this those to too up very was we were what when where which who why will with won't "
    "would you your"
).split()

# Polarity words.
POSITIVE_WORDS = (
    "amazing awesome best brilliant clear excellent fantastic favorite good great helpful "
    "impressive informative love loved nice perfect recommend solid useful wonderful works"
).split()
NEGATIVE_WORDS = (
    "annoying awful bad boring broken bug confusing crash dangerous disappointed disappointing "
    "fail fails hate horrible misleading poor risky slow terrible unsafe useless waste worst wrong"
).split()
# Phrases that turn a sentence negative.
NEGATIVE_PHRASES = "(?i)\\b(won't|will not|can't|cannot|couldn't|didn't) (remember|work|recommend|use|watch|trust)\\b|\\bnot (good|helpful|useful|safe|true|worth|working)\\b|\\bunhelpful\\b"

# Words that count as criticism or praise by themselves.
CRITICISM_CUES = "(?i)\\b(unsafe|dangerous|terrible|awful|horrible|worst|useless|misleading|bad|not (good|helpful|useful|safe|true|worth|working))\\b"
PRAISE_CUES = "(?i)\\b(great|love|loved|awesome|amazing|excellent|perfect|fantastic|wonderful|best)\\b"

# Cues for the intent of a comment, tested in the order of use.
SPAM_CUES = "(?i)(https?://|www\\.)\\S*.*\\b(free|giveaway|promo|discount|click|subscribe|whatsapp|telegram)\\b|\\b(free followers|check my (bio|profile)|dm me|click (the )?link)\\b"
LAUGHTER = "(?i)^[\\s\\W]*((lo+l|lmao|rofl|(ha){2,}h?|(he){2,}|xd)[\\s\\W]*)+$"
LAUGHTER_INSIDE = "(?i)\\b(lol|lmao|rofl|(ha){2,}h?)\\b"
AGREEMENT = "(?i)^\\W*(same|this|agreed?|i agree|exactly|true|yes|yep|\\+1|so true|facts)\\b"
DISAGREEMENT = "(?i)\\b(i disagree|disagree with|that's (wrong|not true)|not true|no way)\\b"
CORRECTION = "(?i)^\\W*(do not|don't|actually,|it's not|it is not|stop)\\b"
ADVICE = "(?i)\\b(you should|you could|try (to|this|using)|i (would )?recommend|i suggest|make sure)\\b"
REQUEST = "(?i)\\b(please|can you|could you|would love (to see|a)|wish (you|there|it)|need(s)? (a|an|to add))\\b"
QUESTION_START = "(?i)^\\W*(what|why|how|when|where|who|which|is|are|does|do you|can|should)\\b.*\\?"
META = "(?i)\\b(first comment|who else|anyone (here|else)|here from|algorithm)\\b"
CONFUSION = "(?i)\\b(confus(ed|ing)|don't (get|understand)|makes no sense|lost me)\\b"

# Words that alone are only a reaction.
REACTION_WORDS = "lol lmao haha hahaha rofl wow omg nice cool same this yes no yep nope ok okay damn bruh first".split()

# References to a moment without naming it, and bare pronouns.
VAGUE_REFERENCE = "(?i)\\b(that|this|the) (part|bit|moment|section|scene|point|step)\\b|\\b(that|this) (long|much|far|way)\\b"
BARE_PRONOUN = "(?i)\\b(it|that|this|these|those)\\b"
VAGUE_TIME = "(?i)\\b(earlier|later|back then|at the end|at the start|before that|after that)\\b"
PERSON_PRONOUN = "(?i)\\b(you|he|she|they)\\b"
CONTENT_NOUNS = "(?i)\\b(tips?|video|tutorial|guide|content|channel|post|article|thread|explanation|stuff)\\b"

# Calls to action that say nothing about the content.
GENERIC_CALLS = "(?i)^\\W*(comment( down)? below|like and subscribe|subscribe|follow( me)?( for more)?|like this (video|post)|share this|link in bio)\\W*$"

# Insight categories and their cues.
CATEGORIES = {
    "pain_points": "(?i)\\b(unsafe|risky|broken|bug|crash|slow|confus\\w+|annoying|fails?)\\b",
    "feature_requests": "(?i)\\b(please|wish|would love|need(s)?|should add|can you|could you)\\b",
    "praise": "(?i)\\b(great|love|loved|awesome|amazing|excellent|perfect|useful|helpful|informative)\\b",
    "complaints": "(?i)\\b(hate|terrible|awful|worst|waste|disappoint\\w+|useless|not (good|helpful|useful|worth|working))\\b",
    "suggestions": "(?i)\\b(you should|try|recommend|suggest|make sure|instead)\\b",
}

# Personal data patterns and what replaces them.
PII_PATTERNS = [
    ("[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}", "[email]"),
    ("\\b[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\b", "[ip]"),
    ("\\b[0-9]{13,16}\\b", "[card]"),
    ("\\+?[0-9][0-9 ().-]{7,}[0-9]", "[phone]"),
]

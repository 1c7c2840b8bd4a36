"""Word lists whose values the results depend on."""

# Paraphrases of technical terms.
TORTURED = (
    "profound neural organization",
    "fake neural organization",
    "counterfeit neural organization",
    "phony neural organization",
    "false neural organization",
    "versatile organization",
    "organization ambush",
    "organization assault",
    "organization association",
    "organization activity",
    "remote sensor organization",
    "remote network sensor",
    "enormous information",
    "huge information",
    "immense information",
    "colossal information",
    "monstrous information",
    "gigantic information",
    "tremendous information",
    "information stockroom",
    "information distribution center",
    "information mining",
    "counterfeit consciousness",
    "human-made consciousness",
    "made man-made consciousness",
    "elite figuring",
    "elite execution figuring",
    "haze figuring",
    "cloud figuring",
    "mist figuring",
    "edge figuring",
    "designs preparing unit",
    "focal preparing unit",
    "work process motor",
    "facial acknowledgement",
    "facial recognizable proof",
    "facial verification",
    "discourse acknowledgement",
    "voice acknowledgement",
    "discourse handling",
    "ordinary language handling",
    "regular language handling",
    "mean square mistake",
    "mean square blunder",
    "mean outright mistake",
    "mean supreme blunder",
    "motion to clamor",
    "flag to clamor",
    "sign to commotion",
    "signal to clamor",
    "indicator to noise",
    "worldwide parameters",
    "worldwide ideal arrangement",
    "neighborhood optima",
    "neighborhood ideal arrangement",
    "arbitrary get right of passage to",
    "irregular get right of passage to",
    "arbitrary backwoods",
    "irregular timberland",
    "arbitrary lush territory",
    "arbitrary esteem",
    "irregular esteem",
    "arbitrary number",
    "irregular variable",
    "credulous Bayes",
    "innocent Bayes",
    "stand pivotal",
    "bolster vector machine",
    "choice tree",
    "highlight extraction",
    "include extraction",
    "subterranean insect state",
    "underground creepy crawly settlement",
    "subterranean insect settlement enhancement",
    "molecule swarm enhancement",
    "hereditary calculation",
    "leftover vitality",
    "leftover power",
    "remaining vitality",
    "remaining force",
    "territorial normal vitality",
    "motor vitality",
    "potential vitality",
    "vitality misfortune",
    "vitality utilization",
    "vitality proficiency",
    "individual computerized collaborator",
    "bosom danger",
    "bosom growth",
    "renal disappointment",
    "renal harm",
    "kidney disappointment",
    "liver disappointment",
    "lactose narrow mindedness",
    "blood circulatory strain",
    "coronary illness",
    "cardiovascular illness",
    "insulin opposition",
    "white platelet",
    "red platelet",
    "platelet check",
    "regenerative wellbeing",
    "imperative signs",
    "Joined States",
    "Joined Realm",
    "atomic vitality",
    "atomic family",
    "sun powered vitality",
    "sun based force",
    "sun oriented force",
    "wind vitality",
    "geothermal vitality",
    "petroleum derivative",
    "ozone harming substance",
    "non-renewable energy source",
    "stockpile and request",
    "thickness work",
    "warm vitality",
    "warm conductivity",
    "demolish learning",
    "convolutional neural organization",
    "intermittent neural organization",
    "long short-term memory organization",
    "creating ill-disposed organization",
    "ill-disposed organization",
    "leftover organization",
    "consideration mechanism",
    "consideration component",
    "move learning",
    "shrouded layer",
    "shrouded Markov model",
    "computerized reasoning",
    "man-made brainpower",
    "profound conviction organization",
    "outfit learning",
    "bunching calculation",
    "fluffy rationale",
    "fluffy set",
    "harsh set",
    "slope plummet",
    "angle plunge",
    "back proliferation",
    "actuation work",
    "misfortune work",
    "relapse investigation",
    "straight relapse",
    "calculated relapse",
    "head part investigation",
    "relationship coefficient",
    "covariance grid",
    "disarray grid",
    "lattice duplication",
    "likelihood circulation",
    "Gaussian circulation",
    "certainty span",
    "speculation testing",
    "invalid speculation",
    "elective speculation",
    "centrality level",
    "reproduced strengthening",
    "coronary corridor",
)

# Phrases of the first style profile.
STYLE_GPT = (
    "delve into",
    "delves into",
    "delving into",
    "tapestry of",
    "rich tapestry",
    "intricate tapestry",
    "meticulous",
    "meticulously",
    "intricate interplay",
    "complex interplay",
    "in the realm of",
    "navigating the complex",
    "navigating the intricacies",
    "underscoring the importance",
    "underscores the importance",
    "shed light on",
    "sheds light on",
    "shedding light on",
    "pivotal role",
    "plays a pivotal",
    "groundbreaking",
    "boasts a",
    "boasts an",
    "noteworthy",
    "it's worth noting",
    "comprehensively",
    "comprehensive understanding",
    "leveraging the power",
    "leverage the power",
    "embark on",
    "embark upon",
    "paradigm shift",
    "the multifaceted",
    "a robust framework",
    "robust framework",
    "testament to",
    "stands as a testament",
    "in summary",
    "to summarize",
    "vibrant",
    "captivate",
    "captivating",
    "seamlessly",
    "synergy",
    "synergistic",
    "ever-evolving",
    "ever-changing landscape",
    "cutting-edge",
    "harness the power",
    "treasure trove",
    "kaleidoscope",
)

# Phrases of the second style profile.
STYLE_CLAUDE = (
    "I'd be happy to",
    "I'll help",
    "Let me",
    "Certainly!",
    "Here's a",
    "Of course!",
    "it's important to note",
    "it's worth mentioning",
    "I should mention",
    "to be clear",
    "to be more precise",
    "Let me break this down",
    "I'll address each",
    "There are several",
    "thoughtful",
    "nuanced",
    "trade-offs",
    "consideration",
    "balanced perspective",
    "with that said",
)

# Phrases of the third style profile.
STYLE_GEMINI = (
    "Here's a breakdown",
    "Here are the key",
    "Key Takeaways",
    "Key Points",
    "Important Considerations",
    "Quick Summary",
    "TL;DR",
    "In short,",
    "In essence,",
    "Pros and Cons",
    "Advantages:",
    "Disadvantages:",
    "Limitations:",
    "Absolutely!",
    "Great question!",
    "Excellent question!",
    "That's a fantastic",
)

# Traces of generated text, as patterns without regard to case.
LEAKS = (
    r"as an AI language model",
    r"I(?:'m| am) sorry,? but",
    r"as of my (?:last training|knowledge cutoff|knowledge update)",
    r"regenerate response",
    r"I cannot (?:provide|access|browse)",
    r"I don't have access to (?:real[\-\s]?time|the internet)",
    r"certainly[!,]? here(?:'s| is) (?:the|a)",
)

# Words of method.
METHODOLOGY = (
    "measure",
    "measured",
    "measurement",
    "measurements",
    "method",
    "methods",
    "methodology",
    "methodological",
    "study",
    "studies",
    "studied",
    "experiment",
    "experiments",
    "experimental",
    "investigation",
    "investigations",
    "investigated",
    "observation",
    "observations",
    "observed",
    "analysis",
    "analyses",
    "analyzed",
    "analysed",
    "procedure",
    "procedures",
    "design",
    "designed",
)

# Words of certainty.
CERTAINTY = (
    "clearly",
    "obviously",
    "obvious",
    "certain",
    "certainly",
    "certainty",
    "definite",
    "definitely",
    "definitively",
    "undoubtedly",
    "doubtless",
    "indisputable",
    "indisputably",
    "evidently",
    "evident",
    "unambiguous",
    "unambiguously",
)

# Endings of adjectives.
ADJECTIVE_ENDINGS = ("al", "ic", "ous", "ful", "ive", "ent", "ant")

# Words near which a year is that of a reagent.
REAGENT_CONTEXT = (
    "catalog",
    "catalogue",
    "cat. no",
    "cat no",
    "cat#",
    "cat.#",
    "lot no",
    "lot#",
    "lot.#",
    "reorder",
    "part no",
    "part#",
    "manufacturer",
    "vendor",
    "supplier",
    "antibody",
    "antibodies",
    "monoclonal",
    "polyclonal",
    "clone",
    "primer",
    "primers",
    "reagent",
    "kit",
    "assay kit",
    "purchased from",
    "obtained from",
    "sourced from",
    "from sigma",
    "from millipore",
    "from invitrogen",
    "from thermo",
    "from thermofisher",
    "from cell signaling",
    "from abcam",
    "from biorad",
    "from bio-rad",
    "from agilent",
    "from qiagen",
    "from roche",
    "from idt",
    "from new england biolabs",
    "from neb",
    "instrument",
    "spectrometer",
    "microscope",
    "cytometer",
    "sequencer",
    "thermocycler",
    "imager",
    "centrifuge",
)

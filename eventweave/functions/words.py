"""Word lists and tag sets.

Fixed values: anchors, topics, entities, sentences and HTML text agree with the
published rules only if these lists do.
"""

HTML_SUPPRESSED = "script style template iframe noscript svg".split()
HTML_BLOCKS = (
    "address article aside blockquote div dl dt dd fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td tfoot th thead tr ul"
).split()

CALENDAR = (
    "monday tuesday wednesday thursday friday saturday sunday january february "
    "march april may june july august september october november december"
).split()

ANCHOR_LANGUAGES = ["en"]
ANCHOR_FUNCTION_WORDS = """
    a an the this that these those some any all each every no not nor and or but
    if then than so as at by for from in into of off on onto out over per to up
    upon via with within without about above after against along among around
    before behind below beneath beside between beyond during except inside near
    since through throughout toward towards under until unlike while
    i me my we us our you your he him his she her it its they them their who whom
    whose which what when where why how there here
    is are was were be been being has have had do does did will would shall
    should can could may might must
    one two three four five six seven eight nine ten eleven twelve first second
    third last next new mr mrs ms dr
""".split()

PERSON_TITLES = (
    "mayor minister president governor senator judge chief curator councillor "
    "dr mr mrs ms sir professor general secretary chancellor prime"
).split()
ORGANIZATION_WORDS = (
    "authority council bank transit hydro museum office union ministry company "
    "agency university court party hospital club group service services "
    "department commission committee board inc ltd corporation association"
).split()
PLACE_WORDS = (
    "bay valley river harbor harbour island street lake county province region "
    "city town port mountain coast"
).split()
LEADING_WORDS = "the a an in on at from after as by for".split()
NAME_CONNECTORS = "of and de da do".split()

TOPIC_STOPWORDS = CALENDAR + """
    about above after again against also although among another because been
    before being below between both could does doing down during each even
    every from further have having here into itself just last like made make
    many more most much must near next once only other over said says same
    should since some such than that their them then there these they this
    those though three through today told under until upon very were what when
    where which while will with within without would year years your week weeks
""".split()

SENTENCE_STOPWORDS = """
    the and for are was were has have had that this with from said says will
    would after before into over than then they their them its his her our
    not but all any can one who which when where while about also been being
""".split()

TRACKING_PREFIX = "utm_"
TRACKING_KEYS = (
    "fbclid gclid dclid msclkid mc_cid mc_eid igshid yclid _ga _gl ref_src"
).split()

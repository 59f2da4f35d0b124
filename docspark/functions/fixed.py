"""Words that results depend on, whole, as they are used in controlled documents."""

from __future__ import annotations

# Words without meaning of their own in names and bags of words.
STOP = (
    "and or of the for a an to in on with by is are be this that as at it its if not no all any each from which who will can may must shall "
    "should have has e g eg i ie etc use please insert none add"
).split()

# Forms of "be", and participles that don't end in -ed.
BE = "is are was were be been being".split()
PARTICIPLES = (
    "done made given taken written sent kept held known shown seen found brought built bought caught chosen drawn driven eaten fallen forgotten frozen gotten "
    "hidden laid led left lost meant paid put read run said set shut sold spent split spread stolen stood struck sworn taught told thought thrown understood "
    "won withdrawn worn"
).split()

# Letters after which an e at the end of a word is spoken, and the vowels.
SPOKEN_BEFORE_E = tuple("laeiouy")
VOWELS = "aeiouy"

# Signs in front of a list item.
LIST_SIGNS = "•▪◦‣∙●○*–o-"

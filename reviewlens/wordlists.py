"""Small default word lists. Every operator takes its lists as parameters."""

from __future__ import annotations

# The public English stop-word list that Spark ships, each entry
# split into runs of letters, because tokens are runs of letters.
ENGLISH_STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself
she her hers herself it its itself they them their theirs themselves what which who whom this
that these those am is are was were be been being have has had having do does did doing a an
the and but if or because as until while of at by for with about against between into through
during before after above below to from up down in out on off over under again further then
once here there when where why how all any both each few more most other some such no nor not
only own same so than too very s t can will just don should now ll d m re ve isn aren wasn
weren haven hasn hadn doesn didn won wouldn shan shouldn mustn couldn cannot could let ought
would
""".split()

# Third-person pronouns that can stand for an earlier name.
PRONOUNS = "he she it they him her them his its their".split()

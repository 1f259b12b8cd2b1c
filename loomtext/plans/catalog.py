"""All registered queries of the core."""

from __future__ import annotations

from loomtext.plans.cast import CAST
from loomtext.plans.corpus import CORPUS
from loomtext.plans.dialogue import DIALOGUE
from loomtext.plans.feeds import FEEDS
from loomtext.plans.files import FILES
from loomtext.plans.library import LIBRARY
from loomtext.plans.measures import MEASURES
from loomtext.plans.registry import Registry
from loomtext.plans.relational import RELATIONAL
from loomtext.plans.sound import SOUND
from loomtext.plans.speech import SPEECH
from loomtext.plans.streams import STREAMS
from loomtext.plans.textual import TEXTUAL

CATALOG = Registry()
for part in (FEEDS, TEXTUAL, CAST, SPEECH, LIBRARY, SOUND, STREAMS, CORPUS, DIALOGUE, FILES, MEASURES, RELATIONAL):
    CATALOG.queries.update(part.queries)
    CATALOG.sql.update(part.sql)

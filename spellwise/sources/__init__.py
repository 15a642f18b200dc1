from spellwise.sources.readers import *  # noqa: F401,F403

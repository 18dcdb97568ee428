from trawlframe.sources.tables import *  # noqa: F401,F403

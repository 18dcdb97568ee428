from trawlframe.functions.scalars import *  # noqa: F401,F403
from trawlframe.functions.strict import *  # noqa: F401,F403

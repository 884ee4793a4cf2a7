from lamina.functions.scalar import *  # noqa: F401,F403
from lamina.functions.spelling import *  # noqa: F401,F403

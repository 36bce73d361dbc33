from quire.functions.text import *  # noqa: F401,F403

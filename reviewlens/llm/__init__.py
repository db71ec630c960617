"""Training-data pipeline operators.

Ten operators over document, benchmark, label and conversation tables. Nothing
else in the library imports this subpackage. Its functions are pickled by
value, so Python workers need no copy of the repository on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

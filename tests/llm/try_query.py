"""Runs queries of the corpus operators against their SQL: python tests/llm/try_query.py SF_DIR NAME..."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

if __name__ == "__main__":
    from slotwise.llm.queries import ORACLES, QUERIES
    from slotwise.session import local_session
    from tests.compare import compare, connect

    spark = local_session(cores="8", spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
    con = connect(sys.argv[1])
    for name in sys.argv[2:] or QUERIES:
        began = time.time()
        print(name, compare(spark, name, QUERIES[name], ORACLES.get(name), sys.argv[1], con), f"{time.time() - began:.1f}s", flush=True)
        df = QUERIES[name](spark, sys.argv[1])
        df.show(4, truncate=60)

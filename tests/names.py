"""Print the registered query names of one catalog module."""

import sys

from trackframe import catalog

if __name__ == "__main__":
    queries, _ = catalog.load()
    print(*[n for n, f in queries.items() if f.__module__.endswith("." + sys.argv[1])])

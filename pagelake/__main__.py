import sys

from pagelake.crawl import main

sys.exit(main())

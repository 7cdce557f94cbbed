"""The golden project: nine small files whose results were derived by hand, for tests and as an example."""

from __future__ import annotations

import os

FILES = {
    "main.py": "import core\nimport util\n\nif __name__ == '__main__':\n    core.run_all()\n",
    "core.py": "import util\nimport store\nimport os\n\ndef run_all():\n    for x in store.load_rows():\n        if x:\n            util.fmt_row(x)\n",
    "store.py": "import core\nimport requests_x\n\ndef load_rows():\n    try:\n        return [1]\n    except ValueError:\n        return []\n\ndef never_called():\n    return 0\n",
    "util.py": "def fmt_row(r):\n    return str(r)\n",
    "broken.py": "import util\ndef oops(:\n    pass\n",
    "orphan.py": "X = 1\n",
    "web/app.js": "import React from 'react'\nimport { h } from './helper'\nconst go = (a) => h(a)\n",
    "web/helper.js": "export function h(a) { if (a) { return a } else if (!a) { return 0 } }\n",
    "conf/settings.json": '{"a": 1}\n',
}


def written(folder: str) -> str:
    """The project as files under a folder."""
    for name, text in FILES.items():
        path = os.path.join(folder, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as f:
            f.write(text)
    return folder

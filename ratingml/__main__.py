"""Run a job: ``python -m ratingml <job> <paths...>`` or through spark-submit."""

from __future__ import annotations

import argparse

from ratingml.plans import jobs
from ratingml.session import build_session

JOBS = {
    "train": (jobs.train_and_save, ["ratings_path", "items_path", "model_path"]),
    "prepare": (jobs.prepare_matrix, ["ratings_path", "items_path", "train_path", "test_path"]),
    "boost": (jobs.train_boosted, ["train_path", "test_path"]),
    "boost-reload": (jobs.train_save_and_reload, ["train_path", "test_path", "model_path", "test_rows_path"]),
    "boost-categories": (jobs.train_on_categories, ["ratings_path", "items_path"]),
    "score": (jobs.score_file, ["model_path", "requests_path", "out_path"]),
}


def main() -> None:
    parser = argparse.ArgumentParser(prog="ratingml")
    commands = parser.add_subparsers(dest="job", required=True)
    for name, (job, paths) in JOBS.items():
        command = commands.add_parser(name, help=job.__doc__.splitlines()[0])
        for path in paths:
            command.add_argument(path)
        if name == "train":
            command.add_argument("--algo", default="mlp")
    arguments = vars(parser.parse_args())
    job, _ = JOBS[arguments.pop("job")]
    result = job(build_session(), **arguments)
    reports = getattr(result, "tables", result)
    if not isinstance(reports, dict):
        reports = {"rejected": reports}
    for name, report in reports.items():
        print(name)
        report.show(truncate=False)


if __name__ == "__main__":
    main()

"""Line formats: fields in angle brackets between expressions, compiled to Java expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Formats of known log families.
FORMATS = {
    "HDFS": r"<Date> <Time> <Pid> <Level> <Component>: <Content>",
    "Hadoop": r"<Date> <Time> <Level> \[<Process>\] <Component>: <Content>",
    "Spark": r"<Date> <Time> <Level> <Component>: <Content>",
    "Zookeeper": r"<Date> <Time> - <Level>  \[<Node>:<Component>@<Id>\] - <Content>",
    "OpenStack": r"<Logrecord> <Date> <Time> <Pid> <Level> <Component> \[<ADDR>\] <Content>",
    "BGL": r"<Label> <Timestamp> <Date> <Node> <Time> <NodeRepeat> <Type> <Component> <Level> <Content>",
    "HPC": r"<LogId> <Node> <Component> <State> <Time> <Flag> <Content>",
    "Thunderbird": r"<Label> <Timestamp> <Date> <User> <Month> <Day> <Time> <Location> <Component>(\[<PID>\])?: <Content>",
    "Windows": r"<Date> <Time>, <Level>                  <Component>    <Content>",
    "Linux": r"<Month> <Date> <Time> <Level> <Component>(\[<PID>\])?: <Content>",
    "Mac": r"<Month>  <Date> <Time> <User> <Component>\[<PID>\]( \(<Address>\))?: <Content>",
    "Android": r"<Date> <Time>  <Pid>  <Tid> <Level> <Component>: <Content>",
    "HealthApp": r"<Time>\|<Component>\|<Pid>\|<Content>",
    "Apache": r"\[<Time>\] \[<Level>\] <Content>",
    "Proxifier": r"\[<Time>\] <Program> - <Content>",
    "OpenSSH": r"<Date> <Day> <Time> <Component> sshd\[<Pid>\]: <Content>",
    "hbase": r"<Content>",
    "hive": r"<Content>",
    "OpenSearch": r"<Content>",
    "camel": r"<Content>",
    "activemq": r"<Content>",
    "CoreNLP": r"<Content>",
}


@dataclass(frozen=True)
class LineFormat:
    """A compiled format: its anchored expression, and the group of each field."""

    pattern: str
    groups: dict[str, int]

    def matches(self, line: Column) -> Column:
        return line.rlike(self.pattern)

    def fields(self, line: Column) -> list[Column]:
        return [F.regexp_extract(line, self.pattern, n).alias(name) for name, n in self.groups.items()]


def compile_format(text: str) -> LineFormat:
    """Fields match as little as they can; a run of spaces between them matches any white space."""
    out, groups, count = "^", {}, 0
    for literal, field in re.findall(r"([^<]*|<)(?:<([^<>]+)>)?", text):
        out += re.sub(" +", lambda _: r"\s+", literal)
        count += len(re.findall(r"(?<!\\)\((?!\?)", literal))
        if field:
            count += 1
            groups[field] = count
            out += "(.*?)"
    return LineFormat(out + "$", groups)


def parse_lines(lines: DataFrame, form: LineFormat, line: str = "value") -> DataFrame:
    """The matching lines' fields beside their other columns; lines that do not match are left out."""
    rest = [c for c in lines.columns if c != line]
    return lines.where(form.matches(F.col(line))).select(*rest, *form.fields(F.col(line)))


def malformed_lines(lines: DataFrame, form: LineFormat, line: str = "value") -> DataFrame:
    """The lines that ``parse_lines`` leaves out."""
    return lines.where(~form.matches(F.col(line)))

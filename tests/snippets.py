"""Programs for the tests: each family has the control-flow list named above it."""

# LOOP:d0 LOOP:d1 COND:d2 -- count the cells of a grid that hold the mark
GRID_PY = """
def marked_cells(grid, mark):
    found = 0
    for row in grid:
        for cell in row:
            if cell == mark:
                found += 1
    return found
"""

GRID_PY_RENAMED = """
def hits(table, wanted):
    total = 0
    for line in table:
        for entry in line:
            if entry == wanted:
                total += 1
    return total
"""

GRID_JAVA = """
class Grid {
    static int markedCells(int[][] grid, int mark) {
        int found = 0;
        for (int y = 0; y < grid.length; y++) {
            for (int x = 0; x < grid[y].length; x++) {
                if (grid[y][x] == mark) {
                    found++;
                }
            }
        }
        return found;
    }
}
"""

GRID_CPP = """
int markedCells(const int* grid, int rows, int cols, int mark) {
    int found = 0;
    for (int y = 0; y < rows; ++y) {
        for (int x = 0; x < cols; ++x) {
            if (grid[y * cols + x] == mark) {
                ++found;
            }
        }
    }
    return found;
}
"""

# COND:d0 -- one guard and comprehensions, which count for nothing
GUARD_PY = """
def shorten(names, width):
    if width < 1:
        return []
    cut = [n[:width] for n in names]
    return sorted(set(cut))
"""

# LOOP:d0 COND:d1 COND:d1 -- sort a line's characters into three kinds
KINDS_PY = """
def kinds(line):
    at, digits, spaces = 0, 0, 0
    while at < len(line):
        c = line[at]
        if c.isdigit():
            digits += 1
        elif c == " ":
            spaces += 1
        else:
            at += 0
        at += 1
    return digits, spaces
"""

KINDS_JAVA = """
class Kinds {
    int[] kinds(String line) {
        int at = 0, digits = 0, spaces = 0;
        while (at < line.length()) {
            char c = line.charAt(at);
            if (c >= '0' && c <= '9') {
                digits++;
            } else if (c == ' ') {
                spaces++;
            } else {
                at += 0;
            }
            at++;
        }
        return new int[] {digits, spaces};
    }
}
"""

KINDS_CPP = """
void kinds(const std::string& line, int& digits, int& spaces) {
    size_t at = 0;
    while (at < line.size()) {
        char c = line[at++];
        if (c >= '0' && c <= '9') ++digits;
        else if (c == ' ') ++spaces;
        else continue;
    }
}
"""

# LOOP:d0
DIGITS_LOOP_PY = """
def digit_sum(n):
    total = 0
    while n:
        total += n % 10
        n //= 10
    return total
"""

# COND:d0
DIGITS_REC_PY = """
def digit_sum(n):
    if n < 10:
        return n
    return n % 10 + digit_sum(n // 10)
"""

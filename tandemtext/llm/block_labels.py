"""A small table of labelled text blocks: words and link density before, own, after (-1: no block there), and 1 for content."""

LABELLED = """
30 0 31 0 31 0 1
7 0 22 0 33 0 1
1 0 1 0 37 0 1
6 0 10 0 15 0 1
113 0 25 0 13 0 1
47 0 28 0 7 0 1
31 0 1 0 37 0 1
78 0 92 0 46 0 1
65 0 13 0 6 0 1
25 0 29 0 17 0 1
2 0 1 0 15 0 1
1 0 37 0 9 0 1
32 0 52 0 25 0 1
10 0 114 0 164 0 1
47 0 239 0 66 0 1
36 0 38 0 78 0 1
132 0 117 0 113 0 1
7 0 12 0 29 0 1
5 0 5 0 30 0 1
37 0 17 0 13 0 1
47 0 2 0 1 0 1
51 0 22 0 15 0 1
21 0 103 0 10 0 1
92 0 46 0 167 0 1
11 0 88 0 35 0 1
37 0 2 0 59 0 1
8 0 4 0 4 0 1
38 0 36 0 28 0 1
11 0 5 0 5 0 1
1 0 77 0 37 0 1
9 0 91 0 1 0 1
19 0 9 0 20 0 1
5 0 10 0 172 0 1
23 0 89 0 13 0 1
52 0 25 0 11 0 1
117 0 32 0 46 0 1
17 0 60 0 112 0 1
25 0 32 0 13 0 1
7 0 3 0 7 0 1
8 0 10 0 51 0 1
8 0 11 0 36 0 1
8 0 9 0 12 0 1
9 0 12 0 9 0 1
12 0 9 0 39 0 1
5 0 2 0 2 0 1
2 0 2 0 11 0 1
8 0 11 0 17 0 1
8 0 8 0 8 0 1
8 0 8 0 45 0 1
3 0 8 0 14 0 1
1 1 7 0 8 0 0
1 1 5 0 2 0 0
1 1 10 0 10 0 0
1 1 8 0 9 0 0
1 1 9 0 11 0 0
1 1 6 0 11 0 0
1 1 9 0 7 0 0
1 1 4 0 10 0 0
1 1 8 0 5 0 0
1 1 5 0 9 0 0
1 1 12 0 6 0 0
1 1 12 0 11 0 0
1 1 5 0 10 0 0
9 0 7 0 -1 0 0
2 0 11 0 -1 0 0
76 0 9 0 -1 0 0
103 0 10 0 -1 0 0
20 0 13 0 -1 0 0
25 0 12 0 -1 0 0
22 0 16 0 -1 0 0
28 0 15 0 -1 0 0
21 0 7 0 -1 0 0
172 0 10 0 -1 0 0
8 0 7 0 -1 0 0
92 0 16 0 -1 0 0
5 0 11 0 -1 0 0
59 0 10 0 -1 0 0
1 1 1 1 1 1 0
1 1 1 1 12 0 0
1 1 1 1 9 0 0
-1 0 3 1 2 1 0
2 1 4 1 1 1 0
1 1 60 0 45 0 1
1 1 85 0.02 30 0 1
2 1 120 0 60 0 1
3 1 40 0.05 70 0 1
5 0.8 33 0 50 0 1
80 0 6 0.9 7 1 0
60 0 5 1 4 1 0
90 0.02 70 0.1 -1 0 1
75 0 55 0 -1 0 1
40 0 48 0 -1 0 1
30 0.1 110 0.03 -1 0 1
-1 0 150 0.01 -1 0 1
-1 0 45 0 60 0 1
-1 0 28 0 -1 0 1
-1 0 9 0 4 1 0
4 1 12 0.6 3 1 0
3 1 14 0.5 9 0 0
20 0 9 0.45 4 1 0
50 0 18 0.5 6 1 0
6 1 8 0 4 1 0
4 1 5 0 3 1 0
50 0 25 0.12 40 0 1
35 0.2 20 0.2 25 0.1 1
12 0 10 0.7 -1 0 0
6 1 7 0.3 -1 0 0
"""
